"""Messy tabular files and texts to clean, typed DataFrames."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so that they needn't have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .errors import CircularReferenceError, FileError, FormatError, FormulaError, GridError, NormalizationError, StructureError, UnsupportedFunctionError  # noqa: E402
from .functions.names import sanitize_column_name  # noqa: E402
from .multisheet import MultiSheetParser, analyze_excel, read_all_sheets  # noqa: E402
from .plans.config import CellValue, CircularRefStrategy, DataType, FormatInfo, FormatType, FormulaConfig, FormulaEvaluationMode, HeaderDetectionMode, HeaderFallback, MergeStrategy, MultiSheetOptions, SheetConfig, SheetError, SheetInfo, StructureInfo  # noqa: E402
from .workbook import GridBook, Registry, analyze_structure, read_excel, read_excel_tables  # noqa: E402

__all__ = [
    "CellValue", "CircularRefStrategy", "CircularReferenceError", "DataType", "FileError", "FormatError", "FormatInfo", "FormatType", "FormulaConfig", "FormulaError", "FormulaEvaluationMode", "GridBook", "GridError",
    "HeaderDetectionMode", "HeaderFallback", "MergeStrategy", "MultiSheetOptions", "MultiSheetParser", "NormalizationError", "Registry", "SheetConfig", "SheetError", "SheetInfo", "StructureError", "StructureInfo",
    "UnsupportedFunctionError", "analyze_excel", "analyze_structure", "read_all_sheets", "read_excel", "read_excel_tables", "sanitize_column_name",
]
