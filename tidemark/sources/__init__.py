"""Sources and sinks."""

from tidemark.sources.log import SPLITS, TRAIN_END, VALID_END, csv_log, dimension, event_log, table, with_split
from tidemark.sources.submission import read_submission, submission_rows, violations, write_submission
from tidemark.sources.results import config_cache, content_hash, freeze, load_frozen, save_results, todo

__all__ = ["SPLITS", "TRAIN_END", "VALID_END", "config_cache", "content_hash", "csv_log", "dimension", "event_log", "freeze", "load_frozen", "read_submission", "save_results", "submission_rows", "table", "todo", "violations", "with_split", "write_submission"]
