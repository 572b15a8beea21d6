"""Unicode white space in byte strings."""

from __future__ import annotations

import re

# The Unicode White_Space characters
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII = b"\t\n\v\f\r "
_ONE = b"(?:[\\t-\\r ]|" + b"|".join(re.escape(c.encode()) for c in SPACES if ord(c) > 127) + b")"
_LEAD = re.compile(_ONE + b"+")
_TAIL = re.compile(_ONE + b"+\\Z")
#: white space beyond ASCII
WIDE_SPACE = re.compile(b"|".join(re.escape(c.encode()) for c in SPACES if ord(c) > 127))
#: a byte at which no white space character starts; the later bytes of one are such bytes
INK = re.compile(b"(?!" + _ONE + b").", re.S)


def trim(line: bytes) -> bytes:
    line = line.strip(_ASCII)
    if line and line[0] >= 0x80 and (m := _LEAD.match(line)):
        line = line[m.end() :]
    if line and line[-1] >= 0x80 and (m := _TAIL.search(line)):
        line = line[: m.start()]
    return line


def has_ink(part: bytes) -> bool:
    """Whether anything but white space is in ``part``; a broken byte sequence counts as ink."""
    part = part.strip(_ASCII)
    return bool(part) and (part.isascii() or bool(trim(part)))


#: the same set for Java and RE2 expressions
JAVA_SPACES = r"[\t-\r\x{85}\p{Z}]"
