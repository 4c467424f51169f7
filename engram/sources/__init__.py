"""Readers and writers of files that hosts keep: markdown, sessions, legacy times, mirrors."""
