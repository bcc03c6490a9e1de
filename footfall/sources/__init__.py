"""Sources and sinks: table readers, upload-batch JSON, fixed lookup tables
and the derived fixture views used by the correctness checks."""
