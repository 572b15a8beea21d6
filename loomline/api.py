"""The public names in one place."""

from .functions.languages import Language, LanguageRegistry
from .operators.output import OUTPUT_TYPES, Report, collect_report, json_files, json_languages, pipe_columns, read_report_parts, render, write_report, write_report_parts, xml_report
from .operators.sorting import sort_files, sort_files_with_position, sort_languages, with_position
from .plans.engine import Processor, Result, analyze, analyze_content, analyze_file, analyze_files
from .plans.options import OptionError, Options

__all__ = [
    "OUTPUT_TYPES", "Language", "LanguageRegistry", "OptionError", "Options", "Processor", "Report", "Result", "analyze", "analyze_content",
    "analyze_file", "analyze_files", "collect_report", "json_files", "json_languages", "pipe_columns", "read_report_parts", "render", "sort_files",
    "sort_files_with_position", "sort_languages", "with_position", "write_report", "write_report_parts", "xml_report",
]
