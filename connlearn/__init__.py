"""connlearn: learning and scoring labelled connection records on Spark.

Records are parsed with column expressions, labels profiled and mapped to
classes, categorical columns indexed and one-hot encoded, features scaled
with training statistics, and no-intercept logistic regression fitted and
evaluated - all as DataFrame plans and Spark ML stages.
"""

from .functions import binary_class, sigmoid, strip_terminator, vocabulary_class
from .operators import *  # noqa: F401,F403
from .operators import __all__ as _ops
from .plans import Workflow, WorkflowResult
from .schema import RecordSchema
from .session import clear_staging, ensure_checkpoint_dir, local_session, staging_path
from .sources import (Quarantine, first_lines, format_records, head_sample, parse_records, parse_report, positional_frame, prefix_files,
                      read_records, scan_lines, stage_parquet, write_head_sample, write_lines, write_sample_files)

__all__ = [*_ops, "RecordSchema", "Workflow", "WorkflowResult", "binary_class", "clear_staging", "ensure_checkpoint_dir",
           "format_records", "head_sample", "local_session", "parse_records", "parse_report", "positional_frame",
           "read_records", "Quarantine", "prefix_files", "scan_lines", "sigmoid", "stage_parquet", "staging_path", "strip_terminator", "vocabulary_class",
           "write_head_sample", "write_lines", "write_sample_files", "first_lines"]
