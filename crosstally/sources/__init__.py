"""Readers and writers: files, databases, partner sheets, JSON documents."""
