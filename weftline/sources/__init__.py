"""Readers and writers of annotation, sequence and alignment files."""
