"""Licence scan by a positional index of rare words.

Every template (a licence's notice or a naming phrase) is a row of words. The
index holds, for each template, its ``anchors`` rarest words by document frequency
over the whole corpus, with their places, or as many as leave ``VOTES`` of them when
all the words that ``cover`` lets a notice miss are anchors. A text looks its words up there; each
hit votes for a start of the template (place in the text less place in the
template), and the votes' intersection by start gives the alignments to verify:
a naming phrase needs all its words, a notice needs ``cover`` of its words at
their places, and every template needs its key phrase word for word.

Cases: null and empty texts have no words, places or labels and score 0; repeated
rows are kept; further columns are ignored; an empty table gives an empty table;
whole texts are scanned, whatever their length.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty

#: Naming phrases of the base rules, (label, words).
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Openings of well-known notices, (label, key phrase, words).
NOTICES = [
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "mit license", "released under the mit license"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("gpl", "gnu general public license",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "and or distribute this software for any purpose",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("unlicense", "released into the public domain",
     "this is free and unencumbered software released into the public domain"),
]
ANCHORS, COVER, VOTES = 4, 0.8, 2
BATCH = 2000
SCAN = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        " score double")

#: Letters A-Z to a-z, other bytes that are no word to a blank; bytes from 0x80 on belong to words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def text_words(text: str) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return text.encode().translate(_WORD_BYTES).split()


def _templates() -> list[dict]:
    out = [{"label": label, "words": text_words(words), "key": text_words(words), "base": True} for label, words in BASE]
    return out + [{"label": label, "words": text_words(words), "key": text_words(key), "base": False}
                  for label, key, words in NOTICES]


def document_frequency(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many texts each template word occurs, over all documents; as many rows as the templates have words."""
    wanted = frozenset(vocabulary)

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(wanted.intersection(text_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                         ["word", "n"])

    rows = (docs.select(text_or_empty().alias("text")).mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    return {bytes(r["word"]): r["n"] for r in rows}


def rare_word_index(df: dict[bytes, int], anchors: int = ANCHORS, cover: float = COVER) -> tuple[list[dict], dict[bytes, list[tuple[int, int]]]]:
    """Templates with their anchors, and the postings anchor word -> (template, place)."""
    templates, postings = _templates(), defaultdict(list)
    for t, template in enumerate(templates):
        words = template["words"]
        may_miss = len(words) - math.ceil(cover * len(words))
        rarest = sorted(set(words), key=lambda w: (df.get(w, 0), w))[:1 if template["base"] else max(anchors, may_miss + VOTES)]
        template["need"] = 1 if template["base"] else max(1, min(VOTES, len(rarest) - may_miss))
        for place, word in enumerate(words):
            if word in rarest:
                postings[word].append((t, place))
    return templates, dict(postings)


def scan_words(words: list[bytes], templates: list[dict], postings: dict, cover: float) -> tuple[list[int], set, set, float]:
    """Places of the naming phrases, their labels, the notices' labels, and the best share of a template that was met."""
    votes: dict[tuple[int, int], int] = Counter()
    for at, word in enumerate(words):
        if word in postings:
            for template, place in postings[word]:
                votes[template, at - place] += 1
    places, base, more, score = [], set(), set(), 0.0
    for (t, start), n in votes.items():
        template = templates[t]
        need, key = template["words"], template["key"]
        if n < template["need"]:
            continue
        if template["base"]:
            if start >= 0 and words[start:start + len(need)] == need:
                places.append(start)
                base.add(template["label"])
                score = 1.0
            continue
        met = sum(words[start + k] == w for k, w in enumerate(need) if 0 <= start + k < len(words))
        if met < math.ceil(cover * len(need)):
            continue
        around = words[max(0, start - 2):start + len(need) + 2]
        if any(around[k:k + len(key)] == key for k in range(len(around) - len(key) + 1)):
            more.add(template["label"])
            score = max(score, met / len(need))
    return places, base, more, score


def scan_licenses(docs: DataFrame, anchors: int = ANCHORS, cover: float = COVER) -> DataFrame:
    """One row per document: words, places of the naming phrases, labels and score."""
    prepare(docs.sparkSession)
    vocabulary = sorted({w for t in _templates() for w in t["words"]})
    templates, postings = rare_word_index(document_frequency(docs, vocabulary), anchors, cover)

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = text_words(text)
                    places, base, more, score = scan_words(words, templates, postings, cover)
                    out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None),
                                ",".join(sorted(base)), ",".join(sorted(base | more)), score))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 [f.strip().split(" ")[0] for f in SCAN.split(",")])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
            .mapInArrow(scan, SCAN))
