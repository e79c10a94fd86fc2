"""Sources and sinks: files, tables, change maps, keyword lists."""
