"""Failures that callers can tell apart by their code."""

from __future__ import annotations


class AnalysisError(ValueError):
    """code: file_not_found, empty_file, read_error, no_data, no_numeric_columns, column_not_found, missing_columns, bad_limits, unknown_chart, unknown_study, data_quality_error or no_checkpoint_folder."""

    def __init__(self, code: str, message: str, details: list[str] | None = None):
        super().__init__(message)
        self.code, self.details = code, details or []

    def as_dict(self) -> dict:
        return {"success": False, "error": self.code, "message": str(self), "details": self.details}
