"""Sources and sinks: table scans, the cohort binding, CSV/JSON/model IO."""
