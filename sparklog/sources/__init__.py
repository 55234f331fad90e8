"""Where rows come from and go to: configuration, log files, Parquet tables, generated logs."""
