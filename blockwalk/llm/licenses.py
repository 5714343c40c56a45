"""License scans by conditional compression.

Where a text may hold a license notice, the words around are compressed with each license's
wordings as a raw dictionary. The license that makes the block smallest against plain compression
comes first; the words in which notice and wording differ confirm it.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .text import as_bytes, with_columns


def _gnu() -> dict[str, list[str]]:
    kinds = {"GPL": ("General", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser General", ("2.1", "3.0")), "AGPL": ("Affero General", ("1.0", "3.0"))}
    out = {"LGPL-2.0": ["GNU Library General Public License, version 2", "LGPL-2.0"]}
    for short, (long, versions) in kinds.items():
        for version in versions:
            v = version.removesuffix(".0")
            out[f"{short}-{version}"] = [f"GNU {long} Public License, version {v}", f"GNU {long} Public License v{v}", f"{short}-{version}", f"{short} v{v}", f"{short}v{v}"]
    return out


def _creative_commons() -> dict[str, list[str]]:
    parts = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    out = {"CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0", "CC0-1.0"]}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        long = "-".join(parts[p] for p in kind.split("-"))
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            place = "International" if version == "4.0" else "Unported"
            out[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"CC-{kind}-{version}", f"Creative Commons Attribution{long[11:]} {version} {place} License", f"Creative Commons Attribution{long[11:]} {version}"]
    return out


# fixed values: names of licenses, phrases that grant them, and the words of notices
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache-1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "MPL-1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "BSD-4-Clause": ["BSD 4-Clause License", "BSD-4-Clause"],
    "0BSD": ["BSD Zero Clause License", "0BSD"],
    "ISC": ["ISC License", "ISC"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "Zlib"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "EPL-1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "EPL-2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL-1.2"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL-1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic-2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "OFL-1.1"],
    "PSF-2.0": ["Python Software Foundation License 2.0", "PSF-2.0"],
    "WTFPL": ["WTFPL"],
    **_gnu(),
    **_creative_commons(),
}
PHRASES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "SPDX-License-Identifier: {}"]
_FREE = "you can redistribute it and/or modify it under the terms of the"
_FSF = "as published by the Free Software Foundation"
_LATER = "or (at your option) any later version."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_NAME = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
#: license: (words that must not differ, wordings)
NOTICES = {
    "MIT": ("permission hereby granted", [
        _MIT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.", _MIT]),
    "Apache-2.0": ("apache 2.0", [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"]),
    "GPL-2.0": ("gnu general 2", [
        f"This program is free software; {_FREE} GNU General Public License {_FSF}; either version 2 of the License, {_LATER}",
        f"This program is free software; {_FREE} GNU General Public License version 2 {_FSF}.",
        f"This program is free software; {_FREE} GNU General Public License {_FSF}; version 2 of the License."]),
    "GPL-3.0": ("gnu general 3", [
        f"This program is free software: {_FREE} GNU General Public License {_FSF}, either version 3 of the License, {_LATER}",
        f"This program is free software: {_FREE} GNU General Public License {_FSF}, version 3.",
        f"This program is free software: {_FREE} GNU General Public License version 3 {_FSF}."]),
    "LGPL-2.0": ("gnu library general 2", [
        f"This library is free software; {_FREE} GNU Library General Public License {_FSF}; either version 2 of the License, {_LATER}"]),
    "LGPL-2.1": ("gnu lesser general 2.1", [
        f"This library is free software; {_FREE} GNU Lesser General Public License {_FSF}; either version 2.1 of the License, {_LATER}",
        f"This library is free software; {_FREE} GNU Lesser General Public License version 2.1 {_FSF}."]),
    "LGPL-3.0": ("gnu lesser general 3", [
        f"This program is free software: {_FREE} GNU Lesser General Public License {_FSF}, either version 3 of the License, {_LATER}"]),
    "AGPL-3.0": ("gnu affero general 3", [
        f"This program is free software: {_FREE} GNU Affero General Public License {_FSF}, either version 3 of the License, {_LATER}",
        f"This program is free software: {_FREE} GNU Affero General Public License {_FSF}, version 3."]),
    "MPL-2.0": ("mozilla 2.0", [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]),
    "BSD-2-Clause": ("redistributions reproduce", [_BSD]),
    "BSD-3-Clause": ("redistributions reproduce neither endorse", [f"{_BSD} 3. {_NAME}"]),
    "BSD-4-Clause": ("redistributions reproduce advertising endorse", [
        f"{_BSD} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product "
        f"includes software developed by the organization. 4. {_NAME}"]),
    "ISC": ("permission hereby granted provided appear", [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."]),
    "0BSD": ("permission hereby granted", [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."]),
    "Unlicense": ("unencumbered", [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]),
    "Zlib": ("permission granted alter", [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions"]),
    "BSL-1.0": ("organization reproduce transmit", [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
        "derivative works of the Software"]),
    "EPL-2.0": ("eclipse 2.0", [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0"]),
}
#: words that make another license of it if a wording lacks them
OTHERS = frozenset("affero lesser attribution noncommercial sharealike noderivatives nc sa nd apache mozilla eclipse advertising".split())
#: words before a notice, in its sentence, that turn it round
DENIALS = frozenset("not never nor neither isn aren wasn cannot".split())
#: a notice holds at least one of these; their words may be wrapped
TRIGGERS = ["licens", "licenc", "permission", "redistribut", "source code form", "released under"]
#: a notice may differ from its wording in so many of the wording's words, but in none that name the license
DIFFERENT = 0.1
#: licenses whose saving is that near the best confirmed one are told apart by their words
CLOSE = 0.02

_TRIGGER = re.compile("|".join(t.replace(" ", r"\W+") for t in TRIGGERS))
_TRIGGER_BYTES = re.compile(_TRIGGER.pattern.encode())
#: after a name, "-0" or "-style" make another one
_LONGER = re.compile(r"-(?!only\b|or\b)[^\W_]")
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@dataclass(frozen=True)
class Wording:
    """One wording of a notice and the words that must not differ."""

    text: str
    named: frozenset[str]

    @cached_property
    def words(self) -> list[str]:
        return _words(self.text)

    @cached_property
    def count(self) -> Counter:
        return Counter(self.words)

    @cached_property
    def slack(self) -> int:
        """Words that a notice may have more than the wording."""
        return int(DIFFERENT * len(self.words)) + 1

    @cached_property
    def reach(self) -> tuple[int, int]:
        """Words that a block needs before and after a trigger of the wording to hold it."""
        low = self.text.lower()
        places = _trigger_words(low, [m.start() for m in _WORD.finditer(low)])
        return max(places) + self.slack, len(self.words) - min(places) + self.slack


@dataclass(frozen=True)
class Template:
    """Wordings of one license that are one dictionary: its phrases, or its notice."""

    license: str
    wordings: tuple[Wording, ...]

    @cached_property
    def reach(self) -> tuple[int, int]:
        return max(w.reach[0] for w in self.wordings), max(w.reach[1] for w in self.wordings)

    @cached_property
    def press(self) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict("\n".join(w.text.lower() for w in self.wordings).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_dict_id=False)


def templates() -> list[Template]:
    """Phrases with every name, and the notices."""
    out = []
    for license, names in NAMES.items():
        wordings = [Wording(phrase.format(name), frozenset(_words(name))) for name in names for phrase in PHRASES]
        out.append(Template(license, tuple(wordings)))
    for license, (named, texts) in NOTICES.items():
        out.append(Template(license, tuple(Wording(t, frozenset(named.split())) for t in texts)))
    return out


_plain = None
_templates: list[Template] = []


def _size(press, block: str) -> int:
    return len(press.compress(block.encode()))


def _trigger_words(low: str, starts: list[int]) -> list[int]:
    """Numbers of the words in which triggers begin; ``starts`` are the words' positions."""
    return sorted({bisect_right(starts, m.start()) - 1 for m in _TRIGGER.finditer(low)})


def differences(wording: Wording, block: list[str]) -> tuple[float, int, int]:
    """(share of the wording's words that differ, first and end of the words of the block it
    covers); words before and after the part of the block that matches are not counted. 1 if a
    naming word differs or a word of another license stands in between."""
    if not wording.named <= set(block) or (wording.count - Counter(block)).total() > DIFFERENT * len(wording.words):
        return 1.0, 0, 0
    match = difflib.SequenceMatcher(None, wording.words, block, autojunk=False)
    same = [m for m in match.get_matching_blocks() if m.size]
    kept = {w for m in same for w in wording.words[m.a : m.a + m.size]}
    first, last = same[0].b, same[-1].b + same[-1].size
    shared = sum(m.size for m in same)
    inside, lost = last - first - shared, len(wording.words) - shared
    other = [w for w in block[first:last] if w not in wording.count and (w in OTHERS or any(c.isdigit() for c in w) and not w.isdigit())]
    if not wording.named <= kept or other:
        return 1.0, first, last
    return max(lost, inside) / len(wording.words), first, last


class _Text:
    """A text cut into words, with what its blocks measure without a dictionary."""

    def __init__(self, text: bytes | None):
        self.low = (text or b"").decode(errors="replace").lower()
        self.spans = [m.span() for m in _WORD.finditer(self.low)]
        self.words = [self.low[a:b] for a, b in self.spans]
        self._sizes: dict[tuple[int, int], int] = {}

    def block(self, at: int, done: int, reach: tuple[int, int]) -> tuple[int, int]:
        """First and end of the words around word ``at`` that a wording of this reach may cover."""
        return max(done, at - reach[0]), min(len(self.words), at + reach[1] + 1)

    def saving(self, press, begin: int, end: int) -> float:
        """The share by which a dictionary makes a block smaller."""
        piece = self.low[self.spans[begin][0] : self.spans[end - 1][1]]
        if (begin, end) not in self._sizes:
            self._sizes[begin, end] = _size(_plain, piece)
        return 1 - _size(press, piece) / self._sizes[begin, end]

    def denied(self, first: int) -> bool:
        """Does a word shortly before word ``first``, in the same sentence, turn it round?"""
        for k in range(first - 1, max(-1, first - 4), -1):
            if re.search(r"[.!?;\n]", self.low[self.spans[k][1] : self.spans[k + 1][0]]):
                return False
            if self.words[k] in DENIALS:
                return True
        return False

    def confirmed(self, template: Template, begin: int, end: int, at: int) -> tuple[float, int, int] | None:
        """(difference, -words, end) of the wording that covers word ``at`` with the least
        difference, more words first."""
        block, best = self.words[begin:end], None
        for wording in template.wordings:
            share, first, last = differences(wording, block)
            if share > DIFFERENT or not begin + first <= at < begin + last:
                continue
            if _LONGER.match(self.low, self.spans[begin + last - 1][1]) or self.denied(begin + first):
                continue
            found = (share, -len(wording.words), begin + last)
            best = found if best is None else min(best, found)
        return best


def find_notices(text: bytes | None) -> list[tuple[str, float, float]]:
    """(license, saving, difference) of each notice, in order, wherever lines end.

    At each trigger the words around are compressed with every template. In order of what they
    save, templates are confirmed by their exact words; the first that holds wins, but templates
    that save nearly as much and hold as well are preferred if they cover more words or differ
    less. The words that the notice covers are done with.
    """
    global _plain
    if not _TRIGGER_BYTES.search((text or b"").lower()):
        return []
    if _plain is None:
        _plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        _templates.extend(templates())
    seen = _Text(text)
    out, done = [], 0
    for at in _trigger_words(seen.low, [a for a, _ in seen.spans]):
        if at < done:
            continue
        blocks = [(t, *seen.block(at, done, t.reach)) for t in _templates]
        ranked = sorted(((seen.saving(t.press, begin, end), k) for k, (t, begin, end) in enumerate(blocks)), key=lambda r: (-r[0], r[1]))
        held, best = [], None
        for saving, k in ranked:
            if best is not None and saving < best - CLOSE:
                break
            t, begin, end = blocks[k]
            found = seen.confirmed(t, begin, end, at)
            if found:
                best = saving if best is None else best
                held.append((found[1], found[0], -saving, t.license, found[2]))
        if held:
            _, share, saving, license, done = min(held)
            out.append((license, -saving, share))
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with notices: array of (license, saving, difference) in order of occurrence.

    Null and empty texts have none; a notice that repeats counts each time; columns of ``docs``
    named notices are replaced. Whole texts, one pass, no shuffle; the templates are code.
    """

    @arrow_udf("array<struct<license:string, saving:double, difference:double>>")
    def find(column: pa.Array) -> pa.Array:
        rows = [[dict(zip(("license", "saving", "difference"), n, strict=True)) for n in find_notices(t)] for t in as_bytes(column)]
        kind = pa.list_(pa.struct([("license", pa.string()), ("saving", pa.float64()), ("difference", pa.float64())]))
        return pa.array(rows, kind)

    return with_columns(docs, find(F.col(f"`{text}`")), {"notices": lambda c: c})
