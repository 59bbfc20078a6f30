"""Tables in files: reading by suffix, the exports of profiles, run records and event logs."""
