"""Readers and writers of draws, predictions, candidates and ledgers."""
