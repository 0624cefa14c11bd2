import random

from pathloom.llm import licenses


def test_notices_and_spans(spark):
    long = licenses.TEMPLATES["MIT"][2]
    edited = long.replace("without restriction", "with no restriction at all").replace("sublicense", "relicense")
    rows = [
        (1, "Émile\nReleased under the MIT License.\nend"),
        (2, "x Licensed under CC BY-NC 4.0. y Licensed under the Apache License, Version 2.0."),
        (3, "Licensed under the license of the land, version 7"),
        (4, "word " * 30 + edited + " word" * 30),
        (5, None),
        (6, ""),
        (7, long[:200]),
        (8, "Licensed under the MIT License Licensed under the MIT License"),
        (8, "licensed UNDER the mit-license"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.id, []).extend(r.matches)
    text = dict(rows)
    assert [(m.license, text[1][m.start : m.stop], m.coverage) for m in by[1]] == [("MIT", "Released under the MIT License", 1.0)]
    assert [(m.license, text[2][m.start : m.stop]) for m in by[2]] == [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0")]
    assert by[3] == by[5] == by[6] == by[7] == []
    (m,) = by[4]
    assert m.license == "MIT" and 0.9 < m.coverage < 1 and text[4][m.start : m.stop] == edited
    assert [m.license for m in by[8]] == ["MIT"] * 3
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_template_finds_itself():
    index = licenses.Index(licenses.TEMPLATES)
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            found = index.scan(b"before all " + t.encode() + b" after")
            assert [f[0] for f in found] == [name] and found[0][1] == 1.0


def test_winnowing_keeps_one_of_each_window():
    words = licenses.words_of(licenses.TEMPLATES["MPL-2.0"][0].encode())
    at = [i for i, _ in licenses.winnow(words)]
    assert all(any(i in (j, j + 1) for i in at) for j in range(len(words) - 3))


def slow_alignment(t, words):
    """Best local alignment over all cells: (score, matches), a match worth 2, all else 1 less."""
    score = [[(0, 0)] * (len(words) + 1) for _ in range(len(t) + 1)]
    for i, w in enumerate(t, 1):
        for j, x in enumerate(words, 1):
            a, b, c = score[i - 1][j - 1], score[i - 1][j], score[i][j - 1]
            best = max((a[0] + 2, a[1] + 1) if w == x else (a[0] - 1, a[1]), (b[0] - 1, b[1]), (c[0] - 1, c[1]))
            score[i][j] = best if best[0] > 0 else (0, 0)
    return max(max(r) for r in score)


def test_alignment_against_all_cells():
    rng = random.Random(2)
    for _ in range(300):
        t = rng.choices([b"a", b"b", b"c", b"d", b"e"], k=rng.randint(1, 14))
        words = rng.choices([b"a", b"b", b"c", b"x"], k=rng.randint(0, 8)) + [w for w in t if rng.random() < 0.8 for w in [w] * rng.choice([1, 1, 1, 2])]
        pairs = licenses.aligned(t, words, -len(t), len(words))
        assert all(t[i] == words[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        cost = sum(max(c - a, d - b) - 1 + (0 if (c - a, d - b) != (1, 1) else 0) for (a, b), (c, d) in zip(pairs, pairs[1:]))
        want, matches = slow_alignment(t, words)
        # between two matches, words left out and mismatches: at best the longer gap's
        assert 2 * len(pairs) - cost >= want >= 0 and len(pairs) == matches


def test_against_every_template_by_all_cells(spark):
    """Notices with edits among words: scan() finds what a full alignment with each template finds best."""
    rng = random.Random(6)
    index = licenses.Index(licenses.TEMPLATES)
    longer = [(n, licenses.words_of(x.encode())) for n, texts in licenses.TEMPLATES.items() for x in texts if 20 < len(licenses.words_of(x.encode())) < 120]
    rows = []
    for k, (_, w) in enumerate(longer):
        w = list(w)
        for _ in range(rng.randint(0, len(w) // 15)):
            w[rng.randrange(len(w))] = b"edited"
        rows.append((k, " ".join(rng.choices(["lorem", "ipsum", "dolor"], k=rng.randint(0, 40))) + " " + b" ".join(w).decode() + " amen" * 3))
    got = {r.id: {m.license: m.words for m in r.matches} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        words = licenses.words_of(text.encode())
        best = []
        for name, t in zip(index.names, index.words, strict=True):
            pairs = licenses.aligned(t, words, -len(t), len(words))
            if pairs and len(pairs) / max(len(t), pairs[-1][1] + 1 - pairs[0][1]) >= (1 if len(t) < licenses.SHORT else licenses.COVERAGE) and licenses.same_telling(t, words, pairs):
                assert len(pairs) == slow_alignment(t, words)[1]
                best.append((len(pairs), name))
        assert set(got[k].items()) == ({(max(best)[1], max(best)[0])} if best else set()), (longer[k][0], best)
    assert sum(map(bool, got.values())) > len(rows) * 0.7


def test_licenses_that_differ_by_a_word():
    index = licenses.Index(licenses.TEMPLATES)
    cases = {
        "This work is licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
        "This work is licensed under the GNU Lesser General Public License, version 2.1": ["LGPL-2.1"],
        "This work is licensed under the GNU Lesser General Public License, version 2": [],
        "This work is licensed under the GNU General Public License, version 1": ["GPL-1.0"],
        "This work is licensed under the GNU General Public License, version 7": [],
        "Licensed under CC BY-NC-SA 4.0": ["CC-BY-NC-SA-4.0"],
        "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0"],
        "Licensed under CC BY 4.0": ["CC-BY-4.0"],
        "Licensed under the Apache License, Version 2.0.1": [],
        "Licensed, some say, under the MIT License": [],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": ["CC-BY-NC-ND-4.0"],
    }
    for text, want in cases.items():
        assert [m[0] for m in index.scan(text.encode())] == want, text


def test_long_texts_and_clashing_columns(spark):
    text = "word " * 200_000 + "Released under the MIT License" + " Émile" * 50_000
    df = spark.createDataFrame([(1, text, 5, "x")], "doc_id long, text string, matches long, id string")
    (r,) = licenses.scan(df).collect()
    assert [(m.license, text[m.start : m.stop]) for m in r.matches] == [("MIT", "Released under the MIT License")]
