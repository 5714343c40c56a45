import pytest

from blockwalk.llm import licenses


def found(text):
    return [n[0] for n in licenses.find_notices(text.encode() if text is not None else None)]


WORDINGS = [(t.license, w) for t in licenses.templates() for w in t.wordings]


def test_every_wording_finds_its_license():
    for license, w in WORDINGS:
        assert found(w.text) == [license], w.text
        assert found(f"Prose before it.\n{w.text}\nAnd more prose, long enough to be another block of words altogether.") == [license], w.text


def brute(text):
    """Every wording at every place by its exact words, without compression: at each trigger the
    most words first, then the least difference."""
    low = text.lower()
    spans = [m.span() for m in licenses._WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    seen = licenses._Text(text.encode())
    out, done = [], 0
    for at in licenses._trigger_words(low, [a for a, _ in spans]):
        if at < done:
            continue
        held = []
        for license, w in WORDINGS:
            for begin in range(max(done, at - len(w.words) - w.slack), at + 1):
                block = words[begin : begin + len(w.words) + w.slack]
                if not w.named <= set(block) or sum((w.count - licenses.Counter(block)).values()) > licenses.DIFFERENT * len(w.words):
                    continue
                share, first, last = licenses.differences(w, block)
                if share <= licenses.DIFFERENT and begin + first <= at < begin + last and not licenses._LONGER.match(low, spans[begin + last - 1][1]) and not seen.denied(begin + first):
                    held.append((-len(w.words), share, license, begin + last))
        if held:
            done = min(held)[3]
            out.append(min(held)[2])
    return out


def test_compression_finds_what_the_words_alone_would(words):
    """Wordings of all licenses, changed and wrapped, at all kinds of places."""
    rng = words.rng
    prose = ["You need a license to drive.", "Permission denied.", "We redistribute parcels", "in source code form only", "version 2.1 of the 3 maps"]
    for k, (license, w) in enumerate(WORDINGS):
        if len(w.words) < 20 and k % 9:
            continue
        text = w.text.split()
        if k % 3 == 1 and len(text) > 30:
            text[rng.randrange(len(text))] = "changed"
        text = "".join(x + rng.choice((" ", " ", " ", "\n", "\n * ")) for x in text)
        before, after = (" ".join([words(rng.randint(0, 15)), rng.choice(prose)]) for _ in range(2))
        page = f"{before}. {text} {after}"
        assert found(page) == brute(page), page


def test_wrapped_and_changed_notices():
    mit = licenses.NOTICES["MIT"][1][1]
    w = mit.split()
    wrapped = "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))
    assert found("Copyright someone\n" + wrapped) == ["MIT"]
    assert found(mit.replace("deal in the Software", "deal with that Software")) == ["MIT"]
    assert found(mit.replace("copy", "steal").replace("Software", "potato").replace("without", "with")) == []


GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} Public License{3} as published by the Free Software Foundation"


@pytest.mark.parametrize(("text", "license"), [
    (GNU.format("program", ":", "Affero General", "") + ", either version 3 of the License, or (at your option) any later version.", "AGPL-3.0"),
    (GNU.format("program", ":", "Lesser General", "") + ", either version 3 of the License, or (at your option) any later version.", "LGPL-3.0"),
    (GNU.format("library", ":", "Lesser General", "") + ", either version 3 of the License, or (at your option) any later version.", "LGPL-3.0"),
    (GNU.format("library", ";", "Lesser General", "") + "; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    (GNU.format("library", ";", "Library General", "") + "; either version 2 of the License, or (at your option) any later version.", "LGPL-2.0"),
    (GNU.format("program", ";", "General", " version 2") + ".", "GPL-2.0"),
    (GNU.format("program", ";", "General", "") + "; version 2 of the License.", "GPL-2.0"),
    (GNU.format("program", ":", "General", "") + ", either version 3 of the License, or (at your option) any later version.", "GPL-3.0"),
])
def test_headers_of_the_gnu_family(text, license):
    """Each goes on with the usual paragraph on warranty, which names the license once more."""
    more = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."
    assert found(text) == found("/* Copyright (C) 2019 Some One\n *\n * " + text.replace("under the", "under\n * the") + more) == [license]


def test_bsd_texts_are_told_apart():
    end = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    for license in ("BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"):
        text = licenses.NOTICES[license][1][0]
        assert found("Copyright (c) 2012, Someone. All rights reserved.\n\n" + text + end) == [license]
        assert found(text.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ").replace("4. ", "* ") + end) == [license]


def test_denied_and_other_ids():
    assert found("This is not released under the MIT License") == []
    assert found("It is never licensed under the\nApache License 2.0.") == []
    assert found("Do not panic. Released under the MIT License.") == ["MIT"]
    assert found("# SPDX-License-Identifier: LGPL-2.1-or-later") == ["LGPL-2.1"]
    assert found("# SPDX-License-Identifier: Unlicense") == found("Released under the Unlicense.") == ["Unlicense"]
    assert found("This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.") == ["CC-BY-SA-3.0"]
    assert found("Licensed under CC BY-SA 3.0.") == ["CC-BY-SA-3.0"]
    assert found("Licensed under CC BY-NC-SA 2.5.") == ["CC-BY-NC-SA-2.5"]


def test_naming_words_must_agree():
    assert found("Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert found("Licensed under the Apache License, Version 7.0.") == []
    assert found("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert found("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert found("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert found("Licensed under CC BY 4.0.") == ["CC-BY-4.0"]


def test_inside_a_long_line_and_ordinary_prose(words):
    text = words(200) + " Released under the MIT License. " + words(200)
    assert found(text) == ["MIT"]
    assert found("You need a driving license to drive.\nPermission denied.\nlicense") == []
    assert found(None) == found("") == []


def test_saving_ranks_the_own_template_first():
    """Among all dictionaries the own one makes a notice smallest."""
    for license, (_, texts) in licenses.NOTICES.items():
        block = texts[0].lower()
        sizes = {(t.license, len(t.wordings)): licenses._size(t.press, block) for t in licenses.templates()}
        assert min(sizes, key=sizes.get)[0] == license


def test_table(spark):
    rows = [(1, "Released under the MIT License.\nx\nLicensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, "a " * 50_000), (5, "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + rows[4:]], "doc_id int, text string, notices int")
    got = sorted((r["doc_id"], [n["license"] for n in r["notices"]]) for r in licenses.scan(docs).collect())
    assert got == [(1, ["MIT", "CC-BY-NC-4.0"]), (2, []), (3, []), (4, []), (5, ["MIT"]), (5, ["MIT"])]
    assert licenses.scan(docs.limit(0)).collect() == []


def test_each_notice_of_a_line_and_of_adjacent_lines_counts(words):
    one = "Released under the MIT License. Some words here. Licensed under CC BY-NC 4.0."
    assert found(one) == ["MIT", "CC-BY-NC-4.0"]
    assert found(f"{words(150)} {one} {words(150)} {one}") == ["MIT", "CC-BY-NC-4.0"] * 2
    assert found("Licensed under the MIT License\nLicensed under the Apache License 2.0") == ["MIT", "Apache-2.0"]
    assert found("Released under the MIT License. Released\nunder the MIT License.") == ["MIT", "MIT"]


@pytest.mark.parametrize("id", ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0"])
def test_spdx_lines(id):
    assert found(f"# SPDX-License-Identifier: {id}\nimport os\n") == [id]
    assert found(f"/* SPDX-License-Identifier: {id} */") == [id]
    assert found(f"// SPDX-License-Identifier: {id}-style") == []


@pytest.mark.parametrize("license", ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "BSD-3-Clause", "MIT"])
def test_headers_wrapped_anywhere(license):
    w = licenses.NOTICES[license][1][0].split()
    for width in (3, 7, 12):
        lines = [" ".join(w[i : i + width]) for i in range(0, len(w), width)]
        assert found("/*\n * " + "\n * ".join(lines) + "\n */\nint main;") == [license]
    assert found("// SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0"]
