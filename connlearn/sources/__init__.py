from .records import (Quarantine, first_lines, format_records, head_sample, parse_records, parse_report, positional_frame, prefix_files,
                      read_records, scan_lines, stage_parquet, write_head_sample, write_lines,
                      write_sample_files)

__all__ = ["Quarantine", "first_lines", "format_records", "head_sample", "parse_records", "parse_report", "positional_frame", "prefix_files",
           "read_records", "scan_lines", "stage_parquet", "write_head_sample", "write_lines", "write_sample_files"]
