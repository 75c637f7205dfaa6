"""Sources and sinks: files of rows, sentences and pages, and keyed stores."""
