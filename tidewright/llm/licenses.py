"""License scans: an exact containment join of text blocks with notice templates (operator 4).

A block is a line, or a window of as many words as the template has, whatever lines it crosses: a notice wrapped over
lines, behind comment marks or not, is found as one on a line of its own. A template and a block are sets of words; a block meets a template if it holds at least the
threshold share of the template's words. Words are ordered by their count in the whole corpus, rarest first. A block
that meets a template must hold one of its first |T| - ceil(t |T|) + 1 words (prefix filter) and at least
ceil(t |T|) words (length filter), and after its first shared word enough words must remain on both sides (positional
filter). Only blocks that pass all three are counted out. The templates and phrases are few and fixed, so every
task holds them and the texts are never moved. A window starts at a word of its template, and is counted out where as
many words of the template as it needs stand in it.

Besides, the places where a base phrase's words stand consecutively are listed; places may cross lines.

Null and empty texts have no word and no place. Repeated rows give equal rows. Extra columns are kept; a column named
like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.columns import with_arrow_columns
from tidewright.llm.text import ALNUM, Words, words

#: Base phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices and their labels.
TEMPLATES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
]
THRESHOLD = 0.8


def split_words(text: str) -> list[str]:
    """The words of a short text by the same rule as for documents."""
    return [bytes(w.data[s:e]).decode() for w in words(pa.array([text]), ALNUM) for s, e in zip(w.starts, w.ends, strict=True)]


class Scanner:
    """Templates and phrases over a vocabulary of hashed words in order of corpus frequency."""

    def __init__(self, counts: dict[str, int] | None = None, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> None:
        self.phrases = [(split_words(p), label) for p, label in phrases.items()]
        sets = [(label, set(split_words(t))) for label, t in templates]
        vocabulary = set().union(*(s for _, s in sets), *(p for p, _ in self.phrases))
        self.words = sorted(vocabulary, key=lambda w: ((counts or {}).get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.words)}
        hashes = np.concatenate([w.hashes() for w in words(pa.array([" ".join(self.words)]), ALNUM)])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.phrases = [([rank[w] for w in p], label) for p, label in self.phrases]
        self.templates = []
        self.lengths = [len(split_words(t)) for _, t in templates]
        self.starters: dict[int, list[int]] = {}
        for label, s in sets:
            ranks = sorted(rank[w] for w in s)
            need = int(np.ceil(threshold * len(ranks) - 1e-9))
            for r in ranks[: len(ranks) - need + 1]:
                self.starters.setdefault(r, []).append(len(self.templates))
            self.templates.append((label, ranks, need))
        self.is_starter = np.zeros(len(self.words) + 1, bool)
        self.is_starter[list(self.starters)] = True

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the frequency order, -1 for words of no template or phrase."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def places(self, w: Words, ranks: np.ndarray) -> list[tuple[int, int, str]]:
        """(row, word from 0, label) of every place of a base phrase, in no certain order."""
        row, out = w.row_of_word(), []
        for phrase, label in self.phrases:
            at = np.flatnonzero(ranks[: len(ranks) - len(phrase) + 1] == phrase[0])
            for k, r in enumerate(phrase[1:], 1):
                at = at[ranks[at + k] == r]
            at = at[row[at] == row[at + len(phrase) - 1]]
            out += [(int(row[i]), int(i - w.first[row[i]]), label) for i in at]
        return out

    def blocks(self, w: Words, ranks: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int, str, float]]:
        """(row, first word, words, label, containment) of every line that meets a template."""
        hit = np.flatnonzero(self.is_starter[ranks])
        if not len(hit):
            return
        line = np.cumsum(w.data == 0x0A)[w.starts] + w.row_of_word()
        last = None
        for i in hit.tolist():
            if line[i] == last:
                continue
            last = line[i]
            s, e = np.searchsorted(line, [last, last + 1])
            row = int(np.searchsorted(w.first, s, "right")) - 1
            size = len(np.unique(hashes[s:e]))
            held = np.unique(ranks[s:e])
            held = held[held >= 0].tolist()
            place = {r: k for k, r in enumerate(held)}
            for t in {t for r in held for t in self.starters.get(r, ())}:
                label, wanted, need = self.templates[t]
                if size < need:
                    continue
                i0 = next(k for k, r in enumerate(wanted) if r in place)
                if 1 + min(len(wanted) - i0 - 1, len(held) - place[wanted[i0]] - 1) < need:
                    continue
                both = sum(r in place for r in wanted)
                if both >= need:
                    yield row, int(s - w.first[row]), int(e - s), label, both / len(wanted)


    def windows(self, w: Words, ranks: np.ndarray) -> Iterator[tuple[int, int, int, str, float]]:
        """The same of the best window of each template and row, the first on ties."""
        row = w.row_of_word()
        ends = w.first[1:]
        for (label, wanted, need), n in zip(self.templates, self.lengths, strict=True):
            at = np.flatnonzero(np.isin(ranks, wanted))
            stop = np.minimum(at + n, ends[row[at]])
            end = np.searchsorted(at, stop)
            best: dict[int, tuple[int, int]] = {}
            for i in np.flatnonzero(end - np.arange(len(at)) >= need).tolist():
                both, r = len(np.unique(ranks[at[i : end[i]]])), int(row[at[i]])
                if both >= need and both > best.get(r, (0, 0))[0]:
                    best[r] = both, i
            for r, (both, i) in best.items():
                yield r, int(at[i] - w.first[r]), int(stop[i] - at[i]), label, both / len(wanted)


def word_counts(docs: DataFrame, scanner: Scanner, text: str = "text") -> dict[str, int]:
    """How often the corpus holds each word of the templates and phrases: one small row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(scanner.words), np.int64)
        for batch in batches:
            for w in words(batch["text"], ALNUM):
                ranks = scanner.ranks(w.hashes())
                total += np.bincount(ranks[ranks >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {scanner.words[r["word"]]: r["n"] for r in found.collect()}


_ADDED = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "blocks array<struct<first_word:long,n_words:long,label:string,containment:double>>"
)
_BLOCK = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])


def scan_licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Add what the scan of each whole text finds.

    ``n_words``; ``n_base`` places of base phrases with the ``first_word`` and ``last_word`` they start at;
    ``base_labels`` and, with the templates', ``labels``; ``blocks`` that meet a template; and as ``score`` the
    largest containment among them, 0 where there is none.
    """
    scanner = Scanner(word_counts(docs, Scanner(None, templates, phrases, threshold), text), templates, phrases, threshold)

    def scan(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n = len(batch)
        count, places, blocks = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
        for w in words(batch[text], ALNUM):
            hashes, base = w.hashes(), w.rows.start
            ranks = scanner.ranks(hashes)
            count[w.rows] = w.counts
            for row, at, label in scanner.places(w, ranks):
                places[base + row].append((at, label))
            for row, *block in (*scanner.blocks(w, ranks, hashes), *scanner.windows(w, ranks)):
                blocks[base + row].append(dict(zip(("first_word", "n_words", "label", "containment"), block, strict=True)))
        own = [{label for _, label in p} for p in places]
        more = [{b["label"] for b in found} for found in blocks]
        return {
            "n_words": pa.array(count),
            "n_base": pa.array([len(p) for p in places], pa.int64()),
            "first_word": pa.array([min((at for at, _ in p), default=None) for p in places], pa.int64()),
            "last_word": pa.array([max((at for at, _ in p), default=None) for p in places], pa.int64()),
            "base_labels": pa.array([",".join(sorted(s)) for s in own], pa.string()),
            "labels": pa.array([",".join(sorted(s | m)) for s, m in zip(own, more, strict=True)], pa.string()),
            "score": pa.array([max((b["containment"] for b in found), default=0.0) for found in blocks], pa.float64()),
            "blocks": pa.array([sorted(found, key=lambda b: (b["first_word"], b["label"])) for found in blocks], pa.list_(_BLOCK)),
        }

    return with_arrow_columns(docs, scan, _ADDED)
