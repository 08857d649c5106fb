import random
from itertools import combinations

import pytest

from corvane.llm import license_scan as L


def plain_align(a, b):
    """Patience alignment by recursion, without the bookkeeping of the operator."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    if not a or not b:
        return n
    only = [w for w in a if a.count(w) == 1 and b.count(w) == 1]
    if not only:
        return n + lcs(a, b)
    chain = max_chain([(a.index(w), b.index(w)) for w in only])
    edges = [(-1, -1), *chain, (len(a), len(b))]
    return n + len(chain) + sum(plain_align(a[i + 1 : k], b[j + 1 : m]) for (i, j), (k, m) in zip(edges, edges[1:]))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def max_chain(pairs):
    best = []
    for k, (_, j) in enumerate(pairs):
        best.append(max([best[i] for i in range(k) if pairs[i][1] < j], key=len, default=[]) + [pairs[k]])
    return max(best, key=len)


def brute_licenses(text):
    """Licenses with a stretch of enough coverage, trying every stretch of every template."""
    ws, out = L.words(text), {}
    for name, t in L.TEMPLATES:
        t = L.words(t)
        covered = max((plain_align(ws[i : i + -(-len(t) * 3 // 2)], t) for i in range(len(ws)) if ws[i] in t), default=0) / len(t)
        if covered >= L.LEAST_COVERAGE:
            out[name] = max(out.get(name, 0), round(covered, 6))
    return out


def test_longest_increasing():
    rng = random.Random(2)
    for _ in range(300):
        v = [rng.randrange(12) for _ in range(rng.randrange(9))]
        got = [v[i] for i in L.longest_increasing(v)]
        assert all(a < b for a, b in zip(got, got[1:]))
        best = next(n for n in range(len(v), -1, -1) if any(all(x < y for x, y in zip(c, c[1:])) for c in combinations(v, n)))
        assert len(got) == best


def test_alignment_is_ordered_and_recursive():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        twice = [x for x in a for _ in range(2)], [x for x in b for _ in range(2)]
        if twice[0][:1] != twice[1][:1] and twice[0][-1:] != twice[1][-1:]:  # nothing is unique then: the gap is aligned as a whole
            assert len(L.align(*twice)) == lcs(*twice)
    assert [i for i, _ in L.align("the quick brown fox".split(), "a quick red fox".split())] == [1, 3]


def damaged(text, rng, share):
    out = []
    for w in text.split():
        x = rng.random()
        out += [] if x < share / 3 else ["changed"] if x < share * 2 / 3 else [w, "added"] if x < share else [w]
    return " ".join(out)


def cases():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("the of and lorem ipsum software dolor license under to version".split()) for _ in range(n))
    texts = [None, "", " ... ", "license", "the the the " * 400, "Released under the MIT License.\n" * 5, "licensed under THE apache license, version 2.0"]
    for _, t in L.TEMPLATES:
        for share in (0, 0.15):
            texts.append(f"{prose(rng.randrange(25))} {damaged(t, rng, share)} {prose(rng.randrange(25))}")
    return texts


def test_equals_brute_force(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, id string, found string")
    got = {r["id"]: {x["license"]: x["coverage"] for x in r["found"]} for r in L.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert set(got[i]) == set(brute_licenses(t)), t
        # a whole template ends the search inside it; other coverages are those of the best stretch
        assert got[i] == pytest.approx(brute_licenses(t)), t


def test_spans_and_very_long_texts(spark):
    long = "word " * 200_000 + "Released under the MIT License. " + "word " * 10
    rows = [(1, long), (1, long), (None, "Licensed under CC BY-NC 4.0."), (3, None)]
    found = L.best_license(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(len(r["licenses"]) == r["n_licenses"] and (not r["licenses"] or r["licenses"][0]["license"] == r["license"]) for r in found)
    got = sorted((tuple(r)[:-1] for r in found), key=str)
    mit = (1, "MIT", 1.0, 5, 200_000, 200_004, 1)
    assert got == [mit, mit, (3, None, 0.0, 0, None, None, 0), (None, "CC-BY-NC-4.0", 1.0, 5, 0, 4, 1)]


def test_neighbouring_licenses_are_told_apart(spark):
    by = {name: text for name, text in L.TEMPLATES}
    gpl = "This work is licensed under the GNU {}General Public License, version {}."
    want = [
        ("Released under the Apache License.", None),
        ("Released under the BSD License.", "LicenseRef-BSD"),
        ("Released under the MIT License.", "MIT"),
        ("Licensed under the MIT License.", "MIT"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-NC 3.0.", None),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Licensed under the Eclipse Public License, Version 2.0.", "EPL-2.0"),
        (gpl.format("", 3), "GPL-3.0"),
        (gpl.format("", "3.0"), "GPL-3.0"),
        (gpl.format("", 2), "GPL-2.0"),
        (gpl.format("Lesser ", 3), "LGPL-3.0"),
        (gpl.format("Lesser ", "2.1"), "LGPL-2.1"),
        (gpl.format("Affero ", 3), "AGPL-3.0"),
        (by["GPL-3.0"], "GPL-3.0"),
        (by["GPL-3.0"].replace("GNU General", "GNU Lesser General"), "LGPL-3.0"),
        (by["GPL-3.0"].replace("version 3", "version 2"), "GPL-2.0"),
        (by["CC-BY-4.0"], "CC-BY-4.0"),
        (by["CC-BY-SA-4.0"], "CC-BY-SA-4.0"),
        (by["CC-BY-4.0"].replace("Attribution", "Attribution-NonCommercial"), "CC-BY-NC-4.0"),
        (by["CC-BY-4.0"].replace("4.0 International", "3.0 Unported"), None),
    ]
    got = L.best_license(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["license"], r["n_licenses"]) for r in got} == {i: (name, int(name is not None)) for i, (_, name) in enumerate(want)}


def test_two_clauses_are_not_three():
    by = {name: text for name, text in L.TEMPLATES}
    known = L.Templates(L.TEMPLATES)
    assert known.find(by["BSD-3-Clause"])[0]["license"] == "BSD-3-Clause"
    assert known.find(by["BSD-2-Clause"])[0]["license"] == "BSD-2-Clause"


def test_empty_and_missing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.best_license(empty).count() == 0
    with pytest.raises(ValueError):
        L.scan(empty.drop("text"))
    with pytest.raises(ValueError):
        L.Templates([("x", "...")])
