"""Operators from frames to frames.  Rankings are long: hits(qid, chunk_hash, view, raw, rank)."""
