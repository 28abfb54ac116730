from assayflow.sources.delimited import bad_rows, good_rows, read_delimited, rows_per_file  # noqa: F401
from assayflow.sources.readers import has_glob, read_source, read_stage  # noqa: F401
from assayflow.sources.sinks import republish, save_table, write_csv, write_dataset  # noqa: F401
