from .live import BatchStore, LiveLastN, LiveTimeWindows
from .scoring import read_record_stream, running_confusion, score_stream, start_scoring

__all__ = ["BatchStore", "LiveLastN", "LiveTimeWindows", "read_record_stream", "running_confusion", "score_stream",
           "start_scoring"]
