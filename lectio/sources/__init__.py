from .readers import (read_csv_table, read_tsv_table, read_token_buckets, read_token_outputs, read_raw_lines,
                      read_json_map)
from .sinks import (write_csv_table, write_tsv_table, write_split_text, write_token_buckets, write_token_outputs,
                    write_json_map, write_metrics_report)

__all__ = ["read_csv_table", "read_tsv_table", "read_token_buckets", "read_token_outputs", "read_raw_lines", "read_json_map",
           "write_csv_table", "write_tsv_table", "write_split_text", "write_token_buckets", "write_token_outputs",
           "write_json_map", "write_metrics_report"]
