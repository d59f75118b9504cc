"""Reading survey waves and lookup files, writing snapshots and run results."""
