"""Sources and sinks: the file-system scan, tables as virtual trees, the record log."""
