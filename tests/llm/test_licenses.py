import random
from collections import Counter

from helpers import ODD_TEXTS, docs_frame, with_clashes

from marginscope.llm import licenses as L
from marginscope.llm import queries


def slow_dice(a, b):
    x, y = Counter(L.bigrams(L.words(a))), Counter(L.bigrams(L.words(b)))
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def slow_best(text):
    scored = [(slow_dice(text, t), -k) for k, (_, t) in enumerate(L.TEMPLATES)]
    d, k = max(scored)
    return (d, -k) if d >= L.DICE else None


def test_best_equals_all_comparisons():
    rnd = random.Random(1)
    s = L.Scanner()
    for _ in range(1500):
        w = L.words(rnd.choice(L.TEMPLATES)[1])
        for _ in range(rnd.randint(0, max(1, len(w) // 5))):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice(([], ["other"], [w[at], "more"]))
            w = w or ["x"]
        text = " ".join(w)
        want, got = slow_best(text), s.best(L.words(text))
        assert (got is None) == (want is None) and (got is None or (round(got[0], 9), got[1]) == (round(want[0], 9), want[1]))


def test_every_template_is_found_in_a_document():
    s = L.Scanner()
    for k, (name, text) in enumerate(L.TEMPLATES):
        words = text.split(" ")
        broken = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        (hit,) = s.scan(f"Some prose before it, of a few words.\n\n{broken.upper()}\n\nAnd after.")
        assert hit[0] == name and hit[2] == 2 and hit[3] == 1.0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for at, line in enumerate((r["text"] or "").split("\n")):
            best = slow_best(line)
            if best:
                want.add((r["doc_id"], at, L.TEMPLATES[best[1]][0], round(best[0], 9)))
    got = {(r["doc_id"], r["line"], r["license"], r["dice"]) for r in queries.op7_license_scan(spark, sf).collect() if r["unit"] == "line"}
    assert got == want and want


def test_odd_rows(spark):
    rows = [*ODD_TEXTS, (20, "Released under the MIT License."), (20, "Released under the MIT License."), (21, "MIT"), (22, "Two words.\n\nAll rights reserved.\n")]
    docs = with_clashes(docs_frame(spark, rows), "license", "line", "dice")
    got = sorted((r["doc_id"], r["line"], r["license"], r["dice"]) for r in L.scan(docs).collect())
    assert got == [(20, 0, "MIT", 1.0), (20, 0, "MIT", 1.0), (22, 2, "All-rights-reserved", 1.0)]
    assert L.scan(docs_frame(spark, [])).count() == 0
    assert L.scan(docs, templates=[("none", "word")]).count() == 0


MIT = next(t for _, t in L.TEMPLATES if t.startswith("Permission is hereby"))


def paragraphs(text, *begins):
    """The text with a blank line before each of some beginnings, in lines of ten words."""
    for b in begins:
        assert b in text
        text = text.replace(b, "\0" + b, 1)
    wrap = lambda p: "\n".join(" ".join(p.split()[i : i + 10]) for i in range(0, len(p.split()), 10))
    return "\n\n".join(wrap(p) for p in text.split("\0"))


def test_licences_with_blank_lines_inside_longer_documents():
    s = L.Scanner()
    gpl = next(t for _, t in L.TEMPLATES if t.startswith("This program is free software"))
    bsd = L._BSD + L._DISCLAIMER
    bsd3 = L._BSD + L._THIRD.replace("the copyright holder", "Example Corporation") + L._DISCLAIMER
    apache = next(t for n, t in L.TEMPLATES if n == "Apache-2.0" and "you may not use" in t)
    prose = "Some words of a longer file that tell what it is for.\n\n" * 60
    for name, text in (
        ("MIT", paragraphs(MIT, "The above copyright", "THE SOFTWARE IS")),
        ("GPL-3.0", paragraphs(gpl, "This program is distributed")),
        ("GPL-2.0", paragraphs(gpl.replace("version 3", "version 2"), "This program is distributed")),
        ("AGPL-3.0", paragraphs(gpl.replace("General", "Affero General"), "This program is distributed")),
        ("BSD-2-Clause", paragraphs(bsd, "1. Redis", "2. Redis", "THIS SOFTWARE")),
        ("BSD-3-Clause", paragraphs(bsd3, "1. Redis", "2. Redis", "3. Neither", "THIS SOFTWARE")),
        ("Apache-2.0", paragraphs(apache, "You may obtain", "http://", "Unless required")),
    ):
        hits = s.scan(f"{prose}{text}\n\n{prose}")
        assert [(h[0], h[2], h[4]) for h in hits] == [(name, 120, "window")], (name, hits)
        # beside code, without a blank line, as comments
        code = "import os\n" + "\n".join(f" * {line}" for line in text.split("\n")) + "\ndef f(x):\n    return x\n"
        assert [h[0] for h in s.scan(code)] == [name]


def test_notices_with_other_words_on_their_line():
    s = L.Scanner()
    (hit,) = s.scan("Copyright 2020 A. B. Licensed under the MIT License. See the file LICENSE.")
    assert hit == ("MIT", 1, 0, 1.0, "window")
    assert [h[0] for h in s.scan("x = 1  # SPDX-License-Identifier: Apache-2.0 and more\n\n/* SPDX-License-Identifier: MIT, see the file */ y = 2")] == ["Apache-2.0", "MIT"]
    # the words that licences share do not make one of them
    assert s.scan("// SPDX-License-Identifier: Zlib, see the file") == [] and s.scan("It is licensed under the terms of the license of the seller.") == []


def test_every_copy_of_a_licence_is_found():
    s = L.Scanner()
    text = paragraphs(MIT, "The above copyright", "THE SOFTWARE IS")
    hits = s.scan("\n\n".join([text, text.replace("Software", "Program"), "Other words.", text] * 5))
    assert [h[0] for h in hits] == ["MIT"] * 15


def slow_windows(text, least=L.DICE):
    """Whether any window of words matches any template, all windows compared."""
    w = L.words(text)
    s = L.Scanner()
    for t, size in enumerate(s.sizes):
        for a in range(len(w)):
            for b in range(a + 2, min(len(w), a + 2 + int(size * 1.6)) + 1):
                g = L.bigrams(w[a:b])
                if set(g) & s.key_of[t] and 2 * sum((Counter(g) & s.counts[t]).values()) / (len(g) + size) >= least:
                    return True
    return False


def test_windows_equal_all_comparisons():
    rnd = random.Random(2)
    s = L.Scanner()
    short = [t for _, t in L.TEMPLATES if len(L.words(t)) < 14]
    seen = Counter()
    for _ in range(150):
        w = L.words(rnd.choice(short))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice(([], ["other"], [w[at], "more"]))
            w = w or ["x"]
        text = " ".join(["before", "it"] + w + ["and", "after"])
        seen[slow_windows(text)] += 1
        assert bool(s._windows(L.words(text))) == slow_windows(text)
    assert min(seen[True], seen[False]) > 10
