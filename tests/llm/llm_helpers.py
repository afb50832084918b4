"""Rows and helpers that the operators' tests share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{i}" for i in range(400)]
#: Names that the operators give their own columns.
CLASHES = ["_id", "_text", "_source", "_size", "_key", "_doc", "_copies", "size", "target", "cut", "extra", "whole", "upto", "score", "accepted", "h", "node", "start", "c1", "n", "sig", "_maybe", "_gone", "_word", "_mask", "_s", "kept", "shard", "slot"]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def near(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(99))
    return " ".join(words)


def listed(frame):
    return [tuple(r) for r in frame.collect()]
