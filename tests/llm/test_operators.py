"""Every operator against a brute-force version on a small table of edge cases."""

import collections
import hashlib
import math
import re
import textwrap
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import jaccard_join, langid, licenses, line_chunks, mixing, ppm, quality, sharding, suffix_dedup
from cloudloom.llm.components import components
from cloudloom.llm.queries import QUERIES

from .conftest import BENCH, COLUMNS, crc, rows, words

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_suffix_dedup(spark, sf, docs):
    raw = [(t or "").encode() for _, t in docs]
    want = [(i, len(r), n, s, k) for (i, _), r, (n, s, k) in zip(docs, raw, suffix_dedup.brute_force(raw, 200), strict=True)]
    same([tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, sf).collect()], want)


@pytest.mark.parametrize("hot", [0, 3, 20_000])
def test_suffix_dedup_small_windows(spark, docs, hot):
    """Short repeats, and the way for anchors with many stretches."""
    rng = np.random.default_rng(1)
    raw = [bytes(rng.integers(97, 100, int(n), dtype=np.uint8)) for n in rng.integers(0, 200, 60)]
    df = spark.createDataFrame([(i, r.decode()) for i, r in enumerate(raw)], "doc_id long, text string")
    got = suffix_dedup.without_repeats(df, 12, 5, hot=hot).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    same([tuple(r) for r in got], [(i, *b) for i, b in enumerate(suffix_dedup.brute_force(raw, 12))])


def test_suffix_dedup_keeps_first(spark):
    """With keep_first every string is still there once."""
    rng = np.random.default_rng(2)
    a, b, c = (bytes(rng.integers(97, 123, 80, dtype=np.uint8)) for _ in range(3))
    raw = [a + b, b + c, c + a, a + b]
    df = spark.createDataFrame([(i, r.decode()) for i, r in enumerate(raw)], "doc_id long, text string")
    got = dict(suffix_dedup.without_repeats(df, 30, 10, keep_first=True).select("doc_id", "kept").collect())
    assert bytes(got[3]) == b"" and bytes(got[0]) == a + b
    rest = b"|".join(bytes(got[i]) for i in range(4))
    assert all(x in rest for x in (a, b, c))


def test_longest_factors_against_brute_force():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 2, 60, dtype=np.uint8)
    n = 12
    w = np.lib.stride_tricks.sliding_window_view(text, n)
    pos = np.arange(len(w))
    prev, nxt = suffix_dedup.factor_lengths(w + 97, pos, pos)
    lcp = lambda i, j: next((k for k in range(n) if text[i + k] != text[j + k]), n)
    for i in range(len(w)):
        assert prev[i] == max((lcp(i, j) for j in range(i)), default=0)
        assert nxt[i] == max((lcp(i, j) for j in range(i + 1, len(w))), default=0)


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER).decode())


def test_decontamination(spark, sf, docs):
    wins = collections.defaultdict(set)
    for i, t in BENCH:
        w = item_words(t)
        for k in range(max(len(w) - 7, 1) if w else 0):
            wins[tuple(w[k : k + 8])].add("null" if i is None else str(i))
    want = []
    for i, t in docs:
        w, hit, ids = item_words(t), set(), set()
        for win, items in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= items
        want.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), len(ids) >= 2))
    same([tuple(r)[:6] for r in QUERIES["op2_decontaminate"](spark, sf).collect()], want)


def shingles(t):
    w = (t or "").encode().translate(LOWER).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_links(docs):
    s = [shingles(t) for _, t in docs]
    link = [[b for b in range(len(s)) if b != a and s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])] for a in range(len(s))]
    up = list(range(len(s)))
    for _ in s:
        for a, bs in enumerate(link):
            for b in bs:
                up[a] = up[b] = min(up[a], up[b])
    return link, up


def test_jaccard_join(spark, sf, docs):
    link, up = brute_links(docs)
    got = QUERIES["op3_jaccard_join"](spark, sf).collect()
    same([(r.doc_id, r.n_links) for r in got], [(i, len(x)) for (i, _), x in zip(docs, link, strict=True)])
    group = {}
    for (i, _), u in zip(docs, up, strict=True):
        if i is not None:
            group.setdefault(u, set()).add(i)
    by_class = collections.defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            by_class[r.class_id].add(r.doc_id)
    assert {frozenset(x) for x in by_class.values()} == {frozenset(x) for x in group.values()}


@pytest.mark.parametrize("pivoted", [8, 1000])
def test_jaccard_blocks_and_splits(spark, monkeypatch, pivoted):
    """Large nodes are split, large groups are dealt into block pairs, and no link is lost."""
    for name, value in (("LEAF", 5), ("BLOCK", 7), ("DEPTH", 2), ("PIVOTED", pivoted)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    docs = []
    for i in range(60):
        t = list(base)
        for p in rng.integers(0, 300, 4):
            t[p] = f"e{i}_{p}"
        docs.append((i, " ".join(t)))
    docs += [(100 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 100))) for i in range(20)]
    link, _ = brute_links(docs)
    got = jaccard_join.joined(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.did: r.n_links for r in got} == {i: len(x) for (i, _), x in zip(docs, link, strict=True)}


def test_one_of_each(spark, sf, docs):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 8, 9, 10, 12, 13, 14, 15, 16, 20] and ids.count(None) == 1


def test_runs_meet_the_recall():
    assert jaccard_join.runs_for(0.9) < jaccard_join.runs_for(0.9999)


def test_recall_near_the_threshold(spark):
    """Pairs planted at a Jaccard similarity from 0.8 to 0.85: all that are links are found."""
    rng = np.random.default_rng(11)
    docs, want = [], 0
    for k in range(400):
        base = [f"w{x}" for x in rng.integers(0, 10**7, 200)]
        near = list(base)
        for p in sorted(rng.choice(40, 4, replace=False) * 5):  # up to 20 to 25 of 196 shingles differ on each side
            near[p] = f"e{k}_{p}"
        near += [f"t{k}_{x}" for x in range(int(rng.integers(0, 4)))]
        j = len(shingles(" ".join(base)) & shingles(" ".join(near))) / len(shingles(" ".join(base)) | shingles(" ".join(near)))
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        want += j >= 0.8
    got = jaccard_join.joined(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert want > 200
    assert sum(r.n_links for r in got) >= 2 * 0.99 * want


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2)) if a != b] + [(i, i + 1) for i in range(300, 340)]
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == up


def test_license_scan_counts_words_in_one_pass(spark):
    """A line of very many different words and enough licence words to be compared: time must not grow with the square of its words."""
    lists = [["b", "a", "b"], [], ["x"], ["w"] * 9 + ["v", "w"], [str(i % 37) for i in range(1000)]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>").select("i", licenses.squared_counts(F.col("x")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: sum(k * k for k in collections.Counter(x).values()) for i, x in enumerate(lists)}
    texts = [" ".join([f"w{i}" for i in range(60_000)] + ["license"] * 500), "SPDX-License-Identifier: MIT"]
    began = time.monotonic()
    files = spark.createDataFrame([(str(i), f"{i}/x", t) for i, t in enumerate(texts)], "fid string, path string, text string")
    assert {r.fid: r.own_license for r in licenses.scan(files).collect()} == {"0": None, "1": "MIT"}
    assert time.monotonic() - began < 40


def test_license_scan(spark, sf, docs):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    files = licenses.document_files(df)
    weights, unseen = licenses.term_weights(files)
    n = len(docs)
    count = {w: sum(w in set(item_words(t)) for _, t in docs) for w in weights}
    assert all(math.isclose(weights[w], math.log((1 + n) / (1 + count[w])) + 1) for w in weights)

    templates = [(name, terms, math.sqrt(sum((k * weights[w]) ** 2 for w, k in terms.items()))) for name, terms in licenses.template_terms()]

    def best(i, t):
        out = []
        t = t or ""
        units = [(1, x) for x in t.split("\n")] + [(1, x) for x in re.split(licenses.PARAGRAPH, t) if "\n" in x] + [(0, t)] * (i is not None and i % 100 == 0)
        for whole, unit in units:
            c = collections.Counter(item_words(unit))
            norm = math.sqrt(sum((k * weights.get(w, unseen)) ** 2 for w, k in c.items()))
            for name, terms, length in templates:
                if norm:
                    score = sum(c[w] * k * weights[w] ** 2 for w, k in terms.items()) / norm / length
                    out.append((whole, -round(score, 9), name, score))
        out = [x for x in sorted(out) if x[3] >= licenses.THRESHOLD]
        return (out[0][2], round(min(1.0, out[0][3]), 6)) if out else (None, None)

    got = QUERIES["op4_license_scan"](spark, sf).collect()
    same([(r.doc_id, r.own_license, r.score) for r in got], [(i, *best(i, t)) for i, t in docs])
    assert {r.doc_id: (r.license, r.inherited_from) for r in got}[16] == ("Apache-2.0", "d/en/0")


def test_nearest_ancestor_wins(spark):
    rows = [(1, "LICENSE", "Released under the MIT License"), (2, "a/b/c.py", "x"), (3, "a/LICENSE", "Licensed under CC BY-NC 4.0."), (4, "d/e.py", None), (5, None, "x"), (6, "a/b/d.py", "code\nReleased under the MIT License.\n")]
    got = {r.fid: (r.own_license, r.license) for r in licenses.scan(spark.createDataFrame(rows, "fid long, path string, text string")).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "MIT"), 3: ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), 4: (None, "MIT"), 5: (None, None), 6: ("MIT", "MIT")}


def template(name, start):
    return next(t for n, _, t in licenses.TEMPLATES if n == name and t.lower().startswith(start))


def test_real_licence_texts(spark):
    """Whole licence files, notices over several commented lines, SPDX tags and titles; other licences and prose are not taken for them."""
    mit = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + template("MIT", "mit license. copyright").split("Copyright (c). ")[1].replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    gpl = "# Copyright 2011 Some Body\n#\n" + textwrap.fill(template("GPL-3.0", "this program is free software"), 70, initial_indent="# ", subsequent_indent="# ") + "\n#\ncode = 1\n"
    apache = "/*\n * " + template("Apache-2.0", "licensed under the apache license, version").replace("\n", "\n * ") + "\n *\n * and more here\n */\nint x;"
    bsd = template("BSD-2-Clause", "redistribution and use in source")
    cases = {
        "a/LICENSE": (mit, "MIT"), "b/x.py": (gpl, "GPL-3.0"), "c/x.c": (apache, "Apache-2.0"), "d/COPYING": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nPreamble of many words", "GPL-3.0"),
        "e/LICENSE.txt": ("Copyright (c) 2020, Some Body\nAll rights reserved.\n\n" + bsd, "BSD-2-Clause"), "f/x.rs": ("// SPDX-License-Identifier: MIT\nfn main() {}", "MIT"),
        "g/x.rs": ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), "h/x.rs": ("// SPDX-License-Identifier: EUPL", None), "i/x.md": ("Released under the Ruby license", None),
        "j/x.md": ("Licensed under CC BY 4.0", "CC-BY-4.0"), "k/x.md": ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), "l/x.md": (words(300, 3), None), "m/x.md": ("Mozilla Public License Version 2.0", "MPL-2.0"),
        "n/x.c": ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), "o/x.c": ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), "p/x.md": ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    }
    rows = [(path, path, text, "clash", 1) for path, (text, _) in cases.items()] + [(f"z/{i}", f"z/{i}", words(40, i), "clash", 1) for i in range(30)]
    got = {r.path: r.own_license for r in licenses.scan(spark.createDataFrame(rows, "fid string, path string, text string, license string, directory int")).collect()}
    assert {p: got[p] for p in cases} == {p: want for p, (_, want) in cases.items()}


def test_licence_rows_do_not_depend_on_the_split(spark, monkeypatch):
    """Files are the same in every read of the table, however many tasks read it."""
    docs = spark.createDataFrame(rows(), COLUMNS)
    files = lambda n: sorted(r.fid for r in licenses.document_files(docs.repartition(n)).collect())
    assert files(2) == files(7)


def test_language_accuracy(spark):
    rows = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_edges(spark, sf, docs):
    got = QUERIES["op5_language_id"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (crc(r.doc_id) % 4 == 2 if r.doc_id is not None else False)
        assert (r.lang_pred == "und") == (r.doc_id in (4, 5, 6))


def test_network_gradients_and_tables():
    rng = np.random.default_rng(0)
    net = langid.ByteConvNet(["a", "b", "c"])
    x, y = rng.integers(0, 256, (6, 40)).astype(np.uint8), rng.integers(0, 3, 6)
    _, g = net.gradients(x, y)
    for k in ("out", "f3", "embed", "b2"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][i] += 1e-5
        hi = net.gradients(x, y)[0]
        net.p[k][i] -= 2e-5
        lo = net.gradients(x, y)[0]
        net.p[k][i] += 1e-5
        assert abs((hi - lo) / 2e-5 - g[k][i]) < 1e-4
    assert np.allclose(langid.window_probabilities(net.folded(), x), net.forward(x)[0], atol=1e-4)


def test_shards(spark, sf, docs):
    got = QUERIES["op6_kd_shards"](spark, sf).collect()
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 1 for _, t in docs)
    assert all(0 <= r.shard < 16 and r.law == "bytes" for r in got)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_are_near_equal_and_keep_copies(spark):
    got = QUERIES["op6_kd_shards"](spark, "/root/testdata/sf0.1").groupBy("shard").agg(F.sum("size").alias("b")).collect()
    b = [r.b for r in got]
    assert len(b) == 16 and max(b) - min(b) < 0.02 * sum(b) / 16


def test_hot_group_of_copies_is_split(spark):
    df = spark.createDataFrame([(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    from cloudloom.llm.common import staged

    got = sharding.with_shards(staged(sharding.described(df), "hot"), 7).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    b = [r.b for r in got]
    assert len(b) == 7 and max(b) - min(b) < 0.05 * sum(b) / 7


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_copies_stay_in_one_shard(spark, seed):
    """Groups of up to 2 % of a shard stay whole whatever the data; sizes stay near equal."""
    from cloudloom.llm.common import staged

    rng = np.random.default_rng(seed)
    texts = [f"{i} " + "word " * int(n) for i, n in enumerate(rng.integers(20, 200, 3000))]
    groups = ["copied " + "text " * int(n) + str(g) for g, n in enumerate(rng.integers(20, 200, 40))]
    texts += [g for g in groups for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.with_shards(staged(sharding.described(docs), "copies"), 8).collect()
    shard = {r.doc_id: r.shard for r in got}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    of = collections.defaultdict(set)
    for i, t in enumerate(texts):
        of[t].add(shard[i])
    assert all(len(x) == 1 for x in of.values())
    sizes = collections.Counter()
    for i, t in enumerate(texts):
        sizes[shard[i]] += len(t) + 1
    assert max(sizes.values()) - min(sizes.values()) < 0.06 * sum(sizes.values()) / 8


def test_mixing(spark, sf, docs):
    got = QUERIES["op7_mix_sources"](spark, sf).collect()
    assert len(got) == len(docs)
    by = collections.defaultdict(list)
    for r in got:
        by[(r.source_size, r.target)].append(r)
        assert r.taken <= 3 * r.size
    assert math.isclose(sum(t for _, t in by), sum(s for s, _ in by))
    for (size, target), rs in by.items():
        assert target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in rs) - target) <= max([r.size for r in rs], default=0)


def test_mix_repeats_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = mixing.measured(df)
    want = mixing.times(sizes, mixing.plan(sizes)).agg(F.sum("times")).first()[0]
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == want


def test_quality(spark, sf, docs):
    want = []
    for i, t in docs:
        raw = (t or "").encode()
        w = raw.split()
        win = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cov = {k + j for k in range(len(w) - 2) if win[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines, dup = set(), 0
        for x in raw.split(b"\n"):
            if x.split():
                dup += x in lines
                lines.add(x)
        sym = sum((t or "").count(c) for c in "#*$%&|<>")
        want.append((i, len(w), sum(len(x.decode()) for x in w), sym, dup, len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w)))
    same([tuple(r)[:7] for r in QUERIES["op8_line_quality"](spark, sf).collect()], want)


def test_line_rules():
    assert quality.line_fails("home | about | contact | login") == "navigation"
    assert quality.line_fails("We use cookies to serve you.") == "boilerplate"
    assert quality.line_fails("About us") == "punctuation"
    assert quality.line_fails("The plain sentence ends here.") is None
    text, total, lost = quality.clean_text("good line here.\na | b | c | d\n\nmore text.")
    assert text == "good line here.\n\nmore text." and 0 < lost < total


def test_boilerplate_is_whole_words_in_short_lines():
    for line in ("The design in oak is old.", "A catalog in print helps.", "They spread more butter."):
        assert quality.line_fails(line) is None
    assert quality.line_fails("Please sign in, or log in.") == "boilerplate"
    prose = " ".join(["The sentence goes on for a while."] * 10) + " We read more. " + " ".join(["It ends."] * 10)
    assert quality.clean_text(prose)[::2] == (prose, 0)


def test_lines_of_other_scripts_and_languages():
    thai = "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22\u0e40\u0e1b\u0e47\u0e19\u0e20\u0e32\u0e29\u0e32\u0e17\u0e35\u0e48\u0e21\u0e35\u0e23\u0e30\u0e14\u0e31\u0e1a\u0e40\u0e2a\u0e35\u0e22\u0e07"
    assert quality.line_fails(thai) is None
    assert quality.line_fails("\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed\u770b\u82b1\u7136\u540e\u4e00\u8d77\u56de\u5bb6\u5403\u996d") is None
    assert quality.line_fails("\u9996\u9875") == "punctuation"
    assert quality.line_fails("Este sitio utiliza cookies para mejorar su experiencia.") == "boilerplate"
    assert quality.line_fails("Alle Rechte vorbehalten.") == "boilerplate"


def test_ppm_scores(spark, sf, docs):
    trie, c = ppm.Trie(), collections.Counter()
    low = lambda t: (t or "").encode().translate(LOWER).split()
    for i, t in docs:
        if i is None or crc(i) % 5 != 1:
            c.update(low(t))
            c[None] += 1
            if i != 8:
                trie.learn((t or "").encode())
    long_text = next(t for i, t in docs if i == 8).encode()
    if crc(8) % 5 != 1:
        trie.learn(long_text)
    n, v = sum(c.values()), len(c)
    for r, (i, t) in zip(*(sorted(x, key=lambda q: (q[0] is None, q[0] or 0)) for x in ([tuple(r) for r in QUERIES["op9_ppm_score"](spark, sf).collect()], docs)), strict=True):
        w = [*low(t), None]
        assert r[:5] == (i, i is not None and crc(i) % 5 == 1, len(w), sum(x in c for x in w), n)
        assert math.isclose(r[5], sum(math.log10((c.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r[6], trie.score((t or "").encode()), rel_tol=1e-7, abs_tol=1e-7)


def test_ppm_is_a_distribution_and_adapts():
    trie = ppm.Trie(2).learn(b"abracadabra")
    for history in (b"ab", b"zz", b"ra", b"\0\0"):
        assert math.isclose(sum(10 ** trie.log10(history, s) for s in range(256)), 1, rel_tol=1e-9)
    assert ppm.Trie(3).score(b"abcabcabcabc", adapt=True) > ppm.Trie(3).score(b"abcabcabcabc")


def test_ppm_drops_no_count(spark):
    rows = [(i, f"the {w} sat on the {v}, and {w} {i} saw it") for i, (w, v) in enumerate([("cat", "mat"), ("dog", "log"), ("zebra", "quilt"), ("owl", "yew")] * 4)]
    trie = ppm.Trie()
    for i, t in rows:
        if crc(i) % 5 != 1:
            trie.learn(t.encode())
    got = {r["doc_id"]: r for r in ppm.scored(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=200).collect()}
    assert len({r["held_out"] for r in got.values()}) == 2
    for i, t in rows:
        assert math.isclose(got[i]["score"], trie.score(t.encode()), rel_tol=1e-9)


def line_starts(lines):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    twice = lambda i: lines[i] == lines[i + 1] and lines[i].strip(" \t\n\v\f\r") != ""
    return [i for i in range(len(lines)) if i == 0 or (i + 1 < len(lines) and (md5(md5(lines[i]) + md5(lines[i + 1]))[0] in "01234567" or twice(i)))]


def brute_lines(docs):
    """The lines that stay of every document, with the number of its chunks; docs of equal id are equal."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    lines = [(t or "").split("\n") for _, t in docs]
    starts = [line_starts(x) for x in lines]
    first, out = {}, {}
    for d in order:
        mine, gone = lines[d], set()
        for k, i in enumerate(starts[d]):
            if i + 1 == len(mine):
                continue
            f, a = first.setdefault((mine[i], mine[i + 1]), (d, i))
            if docs[f] == docs[d] and a == i:
                continue
            theirs, m = lines[f], starts[f].index(a)
            ends = [s[n + 1] if n + 1 < len(s) else len(x) - 1 for s, n, x in ((starts[d], k, mine), (starts[f], m, theirs))]
            on = 0
            while i + on <= ends[0] and a + on <= ends[1] and mine[i + on] == theirs[a + on]:
                on += 1
            back = 0
            least = [s[n - 1] if n else 0 for s, n in ((starts[d], k), (starts[f], m))]
            while i - back - 1 >= least[0] and a - back - 1 >= least[1] and mine[i - back - 1] == theirs[a - back - 1]:
                back += 1
            if sum(bool(x.strip(" \t\n\v\f\r")) for x in mine[i - back : i + on]) >= 2:
                gone.update(range(i - back, i + on))
        out[d] = ([x for i, x in enumerate(mine) if i not in gone], len(starts[d]))
    return [out[d] for d in range(len(docs))]


def test_line_chunks(spark, sf, docs):
    got = collections.Counter((r.doc_id, r.n_lines, r.n_chunks, r.n_removed_lines, r.kept_sha256) for r in QUERIES["op10_line_chunks"](spark, sf).collect())
    want = []
    for (i, t), (keep, n) in zip(docs, brute_lines(docs), strict=True):
        whole = len((t or "").split("\n"))
        want.append((i, whole, n, whole - len(keep), sha("\n".join(keep).encode())))
    assert got == collections.Counter(want)


def test_line_chunks_random(spark):
    """Few different lines, blank ones among them: repeats within and across documents, overlapping ones too."""
    rng = np.random.default_rng(4)
    docs = [(i, "\n".join(["", "a", "b c", "d", " ", "é f", "a"][k] if rng.random() < 0.7 else f"own {i} {k} {rng.random()}" for k in rng.integers(0, 7, int(rng.integers(1, 40))))) for i in range(60)]
    got = {r.doc_id: r.kept_text for r in line_chunks.kept(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: "\n".join(keep) for (i, _), (keep, _) in zip(docs, brute_lines(docs), strict=True)}


def test_line_chunks_keep_one_copy(spark):
    rng = np.random.default_rng(4)
    passage = [f"shared line {i} of the passage" for i in range(30)]
    docs = [(i, "\n".join([f"own {i} {x}" for x in range(int(rng.integers(1, 6)))] + passage + [f"end {i}"])) for i in range(12)]
    got = {r.doc_id: r.kept_text.split("\n") for r in line_chunks.kept(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1].split("\n")
    assert all(got[i] == [x for x in t.split("\n") if x not in passage] for i, t in docs[1:])


def test_line_chunks_recall(spark):
    """Of passages of n lines in fresh surroundings, all lines or none go: all of them in 1 - 0.5 ** (n - 1) of the cases."""
    docs, n_of = [], {}
    for n in (2, 3, 5, 10):
        for p in range(200):
            for copy in range(2):
                i = len(docs)
                docs.append((i, "\n".join([f"before {i}", *(f"line {k} of {n} {p}" for k in range(n)), f"after {i}", f"last {i}"])))
                n_of[i] = (n, copy)
    caught = collections.Counter()
    for r in line_chunks.kept(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        n, copy = n_of[r.doc_id]
        assert r.n_removed_lines in ((0, n) if copy else (0,))
        caught[n] += r.n_removed_lines > 0
    for n in (2, 3, 5, 10):
        assert abs(caught[n] / 200 - (1 - 0.5 ** (n - 1))) < 0.12, (n, caught[n])


def test_pipeline(spark, sf):
    import corpus_pipeline

    df = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df2 = stage(spark, df, sf)
        assert df2.columns == df.columns
        df = spark.createDataFrame(df2.collect(), df.schema)
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == df.count() and {"doc_id", "shard", "slot"} <= set(out[0].asDict())


def test_pipeline_keeps_clean_documents(spark):
    """At sf0.01: what the first stage rejects fails the base rule or is junk by its lines."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, "/root/testdata/sf0.01")
    gone = docs.join(kept.select("doc_id"), "doc_id", "left_anti").collect()
    for r in gone:
        counts = quality.base_counts(r.text)
        junk = sum(r.text.count(c) for c in "|#%$&*!") > 0.02 * len(r.text)
        assert counts[0] < 50 or 2 * counts[4] > counts[0] or junk


def test_merging_counts_holds_little_besides_parts_and_result():
    rng = np.random.default_rng(2)
    all_keys = np.unique(rng.integers(0, 2**63, 1_000_000, dtype=np.uint64))
    parts = [(all_keys[k::3] if k else all_keys, np.full(len(all_keys[k::3] if k else all_keys), k + 1)) for k in range(3)]
    tracemalloc.start()
    keys, n = ppm.merged_counts(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.ones(len(all_keys), dtype=np.int64)
    want[1::3] += 2
    want[2::3] += 3
    assert (keys == all_keys).all() and (n == want).all()
    assert peak < 50 << 20


def test_anchors_are_found_piece_by_piece():
    """Memory follows the piece, not the batch of rows."""
    texts = [np.random.default_rng(k).integers(0, 256, 300_000, dtype=np.uint8).tobytes() for k in range(14)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["raw"])
    seen = []
    tracemalloc.start()
    for ids, part in suffix_dedup.long_enough(batch, 0, 200):
        suffix_dedup.stretches(part, 200, 50)
        seen += ids
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == list(range(14)) and peak < 150 << 20
