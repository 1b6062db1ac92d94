"""Table readers, sinks and the derived test views."""
