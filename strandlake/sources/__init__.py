"""Readers and writers of sequence, annotation, alignment and report files."""
