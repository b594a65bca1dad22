"""Sources and sinks: table scans, files, artefacts."""
