"""Readers and writers: pose files, session tables, projects and reports. Paths are Hadoop paths; nothing is opened on a local disk."""
