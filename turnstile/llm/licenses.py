"""License scans: MinHash retrieval of templates, then exact containment.

A text is read through overlapping windows.  For a template of ``m``
shingles, windows hold two stretches of at least ``m`` and less than
``1.42 m`` shingles and advance by one stretch, so any occurrence lies whole
in some window.  Windows and templates meet if they agree in any of BANDS
MinHash values (bands of one row).  An occurrence with a fifth of its
shingles changed has a Jaccard similarity of at least ``0.8 / 3.04`` with its
window, which is missed with probability ``0.737 ** 48 < 5e-7``.  Retrieved
templates are then held against the window's shingles exactly.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm import textarrays as ta

BANDS = 48
WIDTH = 5
STRETCHES = tuple(sorted({int(2 ** (k / 2)) for k in range(40)}))    # window steps; a template uses the first that holds it
MAX_TEMPLATES = 10_000       # bound on what tasks carry; pass more in several scans
MAX_TEMPLATE_SHINGLES = 50_000
_SALTS = np.random.default_rng(97).integers(1, 1 << 62, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDY = np.full(256, 0x20, np.uint8)   # letters and digits, A-Z lower-cased; all other ASCII is blank
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _WORDY[_b] = ta._LOWER[_b]

# Common license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
}


def _shingles(data: np.ndarray, offs: np.ndarray):
    folded = _WORDY[data]
    s, e, rows = ta.words(folded, offs)
    return ta.shingles(ta.word_hashes(folded, s, e), rows, len(offs) - 1, WIDTH)


def _minhashes(h: np.ndarray, starts: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of run starts, the (runs, BANDS) smallest salted hashes."""
    out = [np.empty((len(at), BANDS), np.uint64) for at in starts]
    for k, salt in enumerate(_SALTS):
        salted = (h ^ (h >> np.uint64(31)) ^ salt) * salt
        for low, at in zip(out, starts):
            low[:, k] = np.minimum.reduceat(salted, at)
    return out


class Templates:
    """Shingle sets and band values of the templates, by window step."""

    def __init__(self, texts: dict[str, str]):
        if len(texts) > MAX_TEMPLATES:
            raise ValueError(f"at most {MAX_TEMPLATES} templates in a scan")
        self.names = sorted(n for n in texts if texts[n] is not None and re.search(r"\w", texts[n]))
        self.sets, self.places, self.lengths, self.steps = [], [], [], []
        for name in self.names:
            h, _ = _shingles(*ta.text_buffer(pa.array([texts[name]])))
            values, first, times = np.unique(h, return_index=True, return_counts=True)
            self.sets.append(values)
            self.places.append(np.where(times == 1, first, -1))      # -1: in several places
            self.lengths.append(len(h))
            self.steps.append(next(s for s in STRETCHES if s >= len(h)))
        if sum(map(len, self.sets)) > MAX_TEMPLATES * 100 or max(map(len, self.sets), default=0) > MAX_TEMPLATE_SHINGLES:
            raise ValueError("templates are too long for one scan")
        self.by_step = {}
        for step in sorted(set(self.steps)):
            at = [i for i, s in enumerate(self.steps) if s == step]
            joined = np.concatenate([self.sets[i] for i in at])
            begin = np.cumsum([0, *[len(self.sets[i]) for i in at]])[:-1]
            self.by_step[step] = (np.array(at), _minhashes(joined, [begin])[0])

    def matches(self, h: np.ndarray, edge: np.ndarray, threshold: float):
        """(row, template, containment, first shingle, end shingle) of the windows that pass.

        ``h`` holds the shingles of some texts end to end, ``edge`` their bounds.
        """
        if not len(h) or not self.names:
            return
        runs = {}
        for step in self.by_step:
            n = -(-np.diff(edge) // step)
            row = np.repeat(np.arange(len(n)), n)
            runs[step] = (row, edge[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step)
        lows = _minhashes(h, [at for _, at in runs.values()])
        for (step, (row, begin)), low in zip(runs.items(), lows):
            at, bands = self.by_step[step]
            following = np.flatnonzero(row[1:] == row[:-1])
            window = low.copy()
            window[following] = np.minimum(low[following], low[following + 1])
            hits = set()
            for band in range(BANDS):
                for w in np.flatnonzero(np.isin(window[:, band], bands[:, band])):
                    hits |= {(int(w), int(t)) for t in at[bands[:, band] == window[w, band]]}
            for w, t in sorted(hits):
                first, text = int(begin[w]), int(edge[row[w]])
                inside = h[first:min(int(edge[row[w] + 1]), first + 2 * step)]
                share = float(np.isin(self.sets[t], inside).mean())
                if share >= threshold:
                    where = np.flatnonzero(np.isin(inside, self.sets[t])) + first - text
                    yield int(row[w]), t, share, int(where[0]), int(where[-1]) + 1


    def occurrences(self, h: np.ndarray, t: int, begin: int, threshold: float):
        """(containment, first, end) of each occurrence of a template in a stretch of shingles that starts at ``begin``.

        Where a shingle lies, less its place in the template, is where the
        occurrence would start.  A new one begins where the template's places
        go back or the start moves by half a template or more; a shingle that
        the template repeats goes with the one before it.  Neighbouring
        pieces that reach the threshold only together (a notice with a long
        insertion or in another order) are one occurrence.
        """
        known, m = self.sets[t], len(self.sets[t])
        slot = np.minimum(np.searchsorted(known, h), m - 1)
        at = np.flatnonzero(known[slot] == h)
        place = self.places[t][slot[at]]
        cuts, start, last = [0], None, -1
        for i in np.flatnonzero(place >= 0):
            here = at[i] - place[i]
            if start is not None and (place[i] <= last or abs(here - start) * 2 >= max(2, self.lengths[t])):
                cuts.append(int(i))
                start = None
            start, last = here if start is None else start, place[i]

        def found(i, j):
            share = len(np.unique(slot[at[i:j]])) / m
            return share, begin + int(at[i]), begin + int(at[j - 1]) + 1

        out, open_from = [], None
        for i, j in zip(cuts, [*cuts[1:], len(at)]):
            one = found(i, j)
            if one[0] >= threshold:
                out.append(one)
                open_from = None
                continue
            open_from = i if open_from is None else open_from
            both = found(open_from, j)
            if both[0] >= threshold:
                out.append(both)
                open_from = None
        return out


def _scan(templates: Templates, threshold: float):
    def run(batches):
        for b in batches:
            data, offs = ta.text_buffer(b.column(1))
            for i, j in ta.chunks(offs):
                h, rows = _shingles(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                edge = np.searchsorted(rows, np.arange(j - i + 1))
                spans = {}
                for row, t, inside, first, end in templates.matches(h, edge, threshold):
                    spans.setdefault((row, t), []).append((inside, first, end))
                out = [(i + row, templates.names[t], inside, first, end + WIDTH - 1)
                       for (row, t), found in sorted(spans.items()) for _, begin, stop in _merge(found)
                       for inside, first, end in templates.occurrences(h[edge[row] + begin:edge[row] + stop], t, begin, threshold)]
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    names=["doc_id", "license", "containment", "first_word", "end_word"])
    return run


def _merge(spans):
    """Overlapping spans of a template as one stretch with the highest containment."""
    out = []
    for inside, first, end in sorted(spans, key=lambda s: s[1]):
        if out and first < out[-1][2]:
            out[-1] = (max(inside, out[-1][0]), out[-1][1], max(end, out[-1][2]))
        else:
            out.append((inside, first, end))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, containment, first_word, end_word`` of every occurrence.

    Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased; a template with fewer than five words is one shingle and is
    found where a text consists of it.  Containment is the share of the
    template's distinct five-word shingles in the occurrence; ``end_word`` is
    past the last word of the last shingle.  Repeated notices are told apart
    also where they adjoin.  A threshold under 0.8 is refused, because the
    bands would no longer be sure to retrieve every template.  Null and empty texts have no
    rows; repeated rows and null ids stay; other columns are ignored; empty
    tables and no templates give none.  A text is read whole, chunk by chunk.
    """
    if threshold < 0.8:
        raise ValueError("the bands retrieve occurrences with a containment of 0.8 or more")
    ready = Templates(NOTICES if templates is None else templates)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scan(ready, threshold),
                            "doc_id long, license string, containment double, first_word long, end_word long")
