"""Sources and sinks: readers produce the tables the operators take."""
