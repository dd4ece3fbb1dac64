"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are normalised as in decontamination and cut into pieces; the fingerprints of a piece, the least hash of
every window of WINDOW consecutive 8-byte grams, are kept in an inverted index with their places. Winnowing picks the
same grams wherever WINDOW + 7 bytes agree, so a document's fingerprints are looked up only where they are its own
windows' least. Two fingerprints in one diagonal band (one, for pieces with fewer than three) make a candidate, which
is aligned within RATE edits. A template is reported with the bytes of it that matched, as a share of its length, and
the span from the first to the last match, if coverage reaches the limit. Only pieces within REACH times the template's
length of each other add up.

A worker holds templates of at most ``block_bytes`` at a time. Where they are more, documents are read once for each block
of templates, and what was found in a text is gathered, a few rows, to be judged together. Documents are not shuffled.

Cases: null and empty texts give no rows; several templates may be found in one text; a template that occurs twice in
a text is reported once, where most of it stands (the first place, if tied); of templates whose spans overlap, those of
least cost (edits and bytes of the template that are missing) stay, but one of under half another's length never drops
it: a whole text stays beside the notice in it; rows that repeat doc_id and text are reported once; other columns are
ignored.
"""

from __future__ import annotations

from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._align import Patterns, matches
from orrery.llm._store import Scratch

WINDOW, PIECE, RATE, COVERAGE = 6, 96, 0.12, 0.8
REACH, BLOCK_BYTES = 2.0, 4 << 20

RESULT = "doc_id long, license string, coverage double, edits long, start long, end long"

# Grant statements in common wordings, and the notices that publishers ask for (MIT, BSD: their first lines).
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-1.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
# The Creative Commons family, as they word it; versions before 4.0 name another place.
for _code, _title in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _version, _place in {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}.items():
        TEMPLATES[f"CC-{_code}-{_version}-notice"] = f"This work is licensed under a Creative Commons {_title} {_version} {_place} License"
        TEMPLATES[f"CC-{_code}-{_version}" if _code == "BY-NC" else f"CC-{_code}-{_version}-short"] = f"Licensed under CC {_code} {_version}."


def full_texts() -> dict[str, str]:
    """Whole license texts that the package ships, under "NAME-text"; only the driver reads them."""
    shipped = sorted(resources.files("orrery.llm").joinpath("licenses").iterdir(), key=lambda f: f.name)
    return {f.name.removesuffix(".txt") + "-text": f.read_text(encoding="utf-8") for f in shipped if f.name.endswith(".txt")}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash (rightmost, if tied) of each window; of all hashes, if they are fewer."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, min(window, len(hashes)))
    return np.unique(np.arange(len(view)) + view.shape[1] - 1 - view[:, ::-1].argmin(1))


class Fingerprints(Patterns):
    """Patterns whose index holds winnowed grams."""

    def bound(self) -> None:
        """Any budget will do: limits() decides."""

    def chosen(self, hashes: np.ndarray) -> np.ndarray:
        return winnow(hashes, WINDOW)

    def limits(self) -> np.ndarray:
        count = np.bincount(self.piece, minlength=len(self.owner))
        return np.where(count < 3, 1, 2)


def choose(found: list[tuple], coverage: float) -> list[tuple]:
    """Of one text's rows (license, covered, size, edits, start, end) those that are reported."""
    best: list[tuple] = []
    for row in sorted(found, key=lambda r: (r[3] + r[2] - r[1], r[0])):
        name, covered, size, edits, start, end = row
        cost = edits + size - covered
        if covered / size >= coverage and not any(start < o[5] and o[4] < end and o[3] + o[2] - o[1] < cost and 2 * o[2] >= size for o in best):
            best.append(row)
    return best


def _blocks(templates: dict[str, str], most: int) -> list[list[str]]:
    """Names in order, in runs of at most ``most`` bytes of text (or one template)."""
    out, held = [], 0
    for name in sorted(templates):
        size = len(templates[name].encode())
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(name)
        held += size
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, license, coverage (0 to 1), edits, start and end (bytes) of each template found in each document; of
    TEMPLATES and full_texts() unless told otherwise."""
    templates = TEMPLATES | full_texts() if templates is None else templates
    blocks = _blocks(templates, block_bytes)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("own", F.xxhash64("doc_id", "text"))
    raw, scratch = None, Scratch(docs.sparkSession)
    for names in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(Fingerprints([(k, templates[n]) for k, n in enumerate(names)], 8, PIECE, RATE))

        def search(batches, names=names, shared=shared):
            index = shared.value
            for batch in batches:
                by: dict[int, list] = {}
                for (t, key), (covered, edits, start, end) in matches(index, batch["text"], index.find(batch["text"], index.limits(), coverage), REACH).items():
                    if covered >= coverage * index.total[key]:
                        by.setdefault(t, []).append((names[key], covered, index.total[key], edits, start, end))
                rows = [(t, *r) for t, own in by.items() for r in (choose(own, coverage) if len(blocks) == 1 else own)]
                cols = list(zip(*rows)) or [[]] * 7
                at = pa.array(cols[0], pa.int64())
                found = [pa.array(c, k) for c, k in zip(cols[1:], (pa.string(), *[pa.int64()] * 5))]
                yield pa.record_batch([batch["doc_id"].take(at), batch["own"].take(at), *found], ["doc_id", "own", "license", "covered", "bytes", "edits", "start", "end"])

        part = plain.mapInArrow(search, "doc_id long, own long, license string, covered long, bytes long, edits long, start long, end long")
        if len(blocks) > 1:  # one block's index at a time
            part = scratch.keep(part)
            shared.destroy()
        raw = part if raw is None else raw.unionByName(part)
    if raw is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    raw = raw.dropDuplicates(["own", "doc_id", "license"])
    if len(blocks) > 1:
        def judge(table: pa.Table) -> pa.Table:
            names = ["license", "covered", "bytes", "edits", "start", "end"]
            rows = choose([tuple(r[n] for n in names) for r in table.to_pylist()], coverage)
            return pa.table([pa.array([table["doc_id"][0].as_py()] * len(rows), pa.int64()), *[pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.int64()) for k in range(6)]], names=["doc_id", *names])

        raw = raw.groupBy("own", "doc_id").applyInArrow(judge, "doc_id long, license string, covered long, bytes long, edits long, start long, end long")
    return raw.select("doc_id", "license", (F.col("covered") / F.col("bytes")).alias("coverage"), "edits", "start", "end")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every (document, license) pair found."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

