"""The training-data operators against brute force, exact round trips and odd input."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motorlens.llm import byte_bpe, exact_dedup, filter_audit, ftrl, license_scan, lm_scoring, ngram_join, quality_classifier, quality_rules, source_mix, token_files, toxicity, url_filter, vector_codes
from motorlens.llm import queries as llm_queries
from motorlens.llm.shared import Scratch, chunks, hashes, segments

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "one", "en", "a", 3), (5, "ONE", "en", None, 3), (6, "x" * 30000, "en", "b", 1),
    (7, "Ünï 漢字 😀 it's 'S we'll\u00a0x\r\n\n", "de", "b", 1), (8, "one", None, "b", 1), (9, "w " * 20000, "en", "c", 1), (10, "it it it it it it", "en", "c", 1),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed=1, words=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(800)]
    return [" ".join(r.choice(vocab) for _ in range(r.randint(3, words))) for _ in range(n)]


def test_words_and_hashes():
    texts = [r[1] for r in ODD]
    for _, _, data, off in chunks(pa.array(texts), 1000):
        starts, ends, first = segments(data, off)
        raw = data.tobytes()
        got = [[raw[s:e] for s, e in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
        assert got == [re.findall(WORD.encode(), raw[i:j]) for i, j in zip(off, off[1:])]
        h = hashes(data, starts, ends)
        by = collections.defaultdict(set)
        for s, e, x in zip(starts, ends, h):
            by[raw[s:e]].add(int(x))
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_bpe_like_the_library(spark):
    import public_tokenizers
    import tiktoken

    path = byte_bpe.default_ranks()
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    r = random.Random(3)
    signs = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "A", "é", "1", "²", "!", "…", "\u3000", "漢", "😀", "\u0301", "\x85"]
    rows = ODD + [(100 + i, "".join(r.choice(signs) for _ in range(r.randint(0, 40))), "en", "a", 1) for i in range(3000)]
    got = {x["doc_id"]: x for x in docs(spark, rows).select("doc_id", byte_bpe.encode_with_offsets(F.col("text"), path).alias("t")).collect()}
    for i, text, *_ in rows:
        want = lib.encode_ordinary(text or "")
        t = got[i]["t"]
        assert t["ids"] == want
        pieces = [(text or "")[a:b] for a, b in zip(t["piece_start"], [*t["piece_start"][1:], None])]
        assert "".join(pieces) == (text or "")
    out = {x["doc_id"]: x for x in byte_bpe.query(spark, docs(spark)).collect()}
    for i, text, *_ in ODD:
        assert out[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, lib.encode_ordinary(text or ""))).encode()).hexdigest()
    assert byte_bpe.query(spark, docs(spark, [])).count() == 0


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    rows = ODD + [(None, "no id", "en", "a", 1), (4, "one more of four", "en", "a", 1)] + [(50 + i, x, "en", "a", 1) for i, x in enumerate(prose(200))] + [(900, "İß.,a <|endoftext|> <|ENDOFTEXT|> H\u0331 =\u0338 0 10 x0", "en", "a", 1)]
    got = token_files.query(spark, docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, base = [], 0
    for i, text, *_ in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, base, len(ids), token_files.crc_of(ids)))
        base += len(ids)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == token_files.crc_of([1])
    assert token_files.query(spark, docs(spark, [])).count() == 0


def test_token_parts_follow_the_bytes(spark, tmp_path, monkeypatch):
    """More text makes more parts, which are written chunk by chunk; what is read back is the same."""
    rows = docs(spark, [(50 + i, x, "en", "a", 1) for i, x in enumerate(prose(400))] + ODD)
    few = token_files.write(rows, f"file://{tmp_path}/few", token_files.default_tokenizer())
    monkeypatch.setattr(token_files, "PART_BYTES", 2000)
    many = token_files.write(rows, f"file://{tmp_path}/many", token_files.default_tokenizer())
    assert len(many["parts"]) > 2 * len(few["parts"])
    both = [sorted(map(tuple, token_files.read(spark, f"file://{tmp_path}/{k}", m).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()), key=repr) for k, m in (("few", few), ("many", many))]
    assert both[0] == both[1]


def brute_components(rows):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(WORD, (text or "").translate({65 + k: 97 + k for k in range(26)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("short", [6, 2])
def test_join_like_brute_force(spark, monkeypatch, short):
    """Also with every list treated as a long one, so that pivots and rounds decide."""
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 20 if short == 2 else 50_000)
    r = random.Random(7)
    rows, base = list(ODD), prose(30, 5)
    for k in range(260):
        words = r.choice(base[:6] if k % 2 else base).split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice("pqrs")
        rows.append((100 + k, " ".join(words), "en", "a", 1))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.query(spark, docs(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("rounds", [0, 1])
def test_join_of_lists_without_links(spark, monkeypatch, rounds):
    """Texts that share passages but hardly a link: every list is long, and what no pivot joins is paired on the grid of cells."""
    for name, value in (("SHORT", 2), ("LIST_ROWS", 7), ("PIVOT_ROUNDS", rounds), ("CELL_BLOCK", 40), ("FLUSH_PAIRS", 30)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(17)
    common = prose(4, 18, 30)
    rows = [(k, " ".join([r.choice(common), *(f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 14)))]), "en", "a", 1) for k in range(150)]
    rows += [(500 + k, rows[k][1] + " x", "en", "a", 1) for k in range(0, 40, 3)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.query(spark, docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_join_filters_never_lose_a_link():
    r = np.random.default_rng(1)
    for _ in range(2000):
        x = np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.9], r.integers(0, 60, r.integers(0, 6)).astype(np.uint64)]))
        n = len(np.intersect1d(x, y))
        assert ngram_join.links(x, y) == (n > 0 and 100 * n >= 80 * (len(x) + len(y) - n))


@pytest.mark.parametrize("held", [8, 1_000_000])
def test_components_like_union_find(spark, monkeypatch, held):
    """A path, a star around a large id, repeated and turned edges, loops and random edges, over several partitions."""
    monkeypatch.setattr(ngram_join, "STAR_ROWS", held)
    r = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(101, 140)] + [(300, 299), (299, 300), (300, 300), (7, 7)]
    edges += [(int(a), int(b)) for a, b in r.integers(1000, 1200, (90, 2))]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = ngram_join.join_components(spark.createDataFrame(edges, "a long, b long").repartition(7), Scratch(spark, "test")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root if find(x) != x)


def test_join_of_ids_with_several_texts(spark):
    """An id whose one row is a copy keeps the links of its other rows; all its rows name one component."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (9, b + " tail"), (11, b[:40]), (12, b[:40]), (20, a + " more"), (None, a), (None, b[:40])]
    for texts in (rows, [*rows, (12, "c " * 30), (30, "c " * 30), (2, "d e f"), (12, "d e f")]):
        got = ngram_join.query(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == brute_documents(texts)


def brute_documents(rows):
    """Rows that share an id are one document; NULL ids take part through their class alone."""
    sets = []
    for _, t in rows:
        w = re.findall(WORD, (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = sorted({i for i, _ in rows if i is not None})
    least = {i: i for i in ids}
    for _ in ids:
        for (i, _), x in zip(rows, sets):
            for (j, _), y in zip(rows, sets):
                if i is not None and j is not None and (i == j or x and y and 100 * len(x & y) >= 80 * len(x | y)):
                    least[i] = least[j] = min(least[i], least[j])
    alike = lambda x: min((least[i] for (i, _), y in zip(rows, sets) if i is not None and x and x == y), default=None)
    return sorted((i or 0, len(x), least[i] if i is not None else alike(x)) for (i, _), x in zip(rows, sets))


def test_join_empty(spark):
    assert ngram_join.query(spark, docs(spark, [])).count() == 0
    assert ngram_join.keep(docs(spark, [(1, None, "a", "b", 1), (2, None, "a", "b", 1)])).count() == 2


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, digest_bytes):
    """One byte of digest makes different texts collide; verification separates them."""
    rows = ODD + [(200 + k, f"text {k % 300}", "en", "a", 1) for k in range(700)] + [(5, "ONE", "en", None, 3)]
    got = exact_dedup.membership(docs(spark, rows), "max", digest_bytes, memtable=50).collect()
    groups = collections.defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    want = [(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def test_compaction_merges_sorted_runs(spark):
    r = random.Random(4)
    rows = [(bytes([r.randrange(40)]) * 3, *((None, None) if (i := r.choice([None, r.randrange(-9, 999)])) is None else (i, i + r.randrange(5))), r.randrange(1, 4)) for _ in range(3000)]
    want = {}
    for d, low, high, n in rows:
        a, b, c = want.get(d, (None, None, 0))
        want[d] = (low if a is None else a if low is None else min(a, low), high if b is None else b if high is None else max(b, high), c + n)
    df = exact_dedup.compact(spark.createDataFrame(rows, exact_dedup.RUNS).repartition(7))
    assert {bytes(x["digest"]): (x["low"], x["high"], x["n"]) for x in df.collect()} == want and df.count() == len(want)
    batch = pa.RecordBatch.from_pylist([{"digest": d, "low": a, "high": b, "n": n} for d, a, b, n in sorted(rows, key=lambda x: x[0])], pa.schema([("digest", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64())]))
    small = [batch.slice(k, 37) for k in range(0, len(rows), 37)]
    assert [x.as_py() for b in exact_dedup.merge(iter(small)) for x in b.column(0)] == sorted(want)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_index_grows_batch_by_batch(spark, digest_bytes):
    """Short digests collide, so bytes must decide; two tables a level are compacted."""
    r, index, seen, all_rows = random.Random(digest_bytes), exact_dedup.Index(spark, 2, digest_bytes, 5), {}, []
    texts = [None, "", "漢字", *prose(40, 21, 6)]
    for b in range(5):
        rows = [(b * 100 + k if r.random() < 0.95 else None, r.choice(texts), "en", "a", 1) for k in range(20 if b != 3 else 0)]
        before, least = set(seen), dict(seen)
        for i, text, *_ in rows:
            t = text or ""
            least[t] = i if least.get(t) is None else least[t] if i is None else min(least[t], i)
        got = index.add(docs(spark, rows), docs(spark, all_rows)).collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter((i, least[t or ""], (t or "") in before) for i, t, *_ in rows)
        seen, all_rows = least, all_rows + rows
    assert len(index.levels) >= 3 and all(len(level) < 2 for level in index.levels)


def test_exact_dedup_keep(spark):
    df = docs(spark, [(1, "a", "x", "y", 1), (1, "a", "x", "y", 1), (2, "a", "x", "y", 1), (3, None, "x", "y", 1), (None, "b", "x", "y", 1), (1, "c", "x", "y", 1)]).withColumn("keep_id", F.lit("clash"))
    out = exact_dedup.keep(df, "max")
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "b"), (1, "c"), (2, "a"), (3, "")]
    assert exact_dedup.keep(docs(spark, []), "min").count() == 0


def test_mix_meets_targets(spark):
    r = random.Random(2)
    rows = ODD + [(100 + k, "w " * r.randint(0, 40), "en", "abcdx"[min(4, k % 9)], 1) for k in range(900)]
    got = source_mix.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(WORD, t or ""))
    assert all(x["taken"] <= 3 * x["size"] for x in got) and sum(x["size"] for x in got) == sum(size(t) for _, t, *_ in rows)
    total, by = sum(x["size"] for x in got), collections.defaultdict(list)
    for x in got:
        by[x["source"]].append(x)
    taken = {s: sum(x["taken"] for x in v) for s, v in by.items()}
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6
    assert sum(taken.values()) <= total
    assert all(v[0]["target"] <= 3 * v[0]["source_size"] for v in by.values())
    big = max(x["size"] for x in got)
    assert all(abs(taken[s] - v[0]["target"]) <= 3 * big for s, v in by.items())
    assert source_mix.query(spark, docs(spark, [])).count() == 0
    kept = source_mix.resample(docs(spark, rows))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert kept.count() == sum(x["copies"] for x in got)


def test_rules_counts(spark):
    rows = ODD + [(100 + k, t + ("\n" + t) * (k % 3), "en", "a", 1) for k, t in enumerate(prose(150, 9, 80))] + [(900, "a b #$ c\n\n a b #$ c\nd", None, None, 1)]
    got = {x["doc_id"]: x for x in quality_rules.query(spark, docs(spark, rows)).collect()}
    for i, text, *_ in rows:
        w = re.findall(WORD, text or "")
        n, marked = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k, x in enumerate(zip(w, w[1:], w[2:])):
            if n[x] > 1:
                marked |= {k, k + 1, k + 2}
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked), failed)
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == want
        assert not (failed and x["kept"])
    assert quality_rules.query(spark, docs(spark, [])).count() == 0


def test_rules_reject_outliers_and_run_no_python(spark):
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(prose(400, 11, 300))]
    junk = [(1000 + k, " ".join(x + "$$$" for x in t.split()), "en", "a", 1) for k, t in enumerate(prose(40, 12, 300))]
    df = quality_rules.query(spark, docs(spark, rows + junk))
    got = [x for x in df.collect() if not x["base_failed"]]
    assert not any(x["kept"] for x in got if x["doc_id"] >= 1000) and all(x["kept"] for x in got if x["doc_id"] < 1000)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def plain_mcd(x, share=quality_rules.SUPPORT, starts=60):
    """Centre and covariance of the smallest determinant over many random starts, with exact halves."""
    floors, r, best = np.diag(np.square(quality_rules.FLOORS)), np.random.default_rng(3), None
    h, factor = int(np.ceil(share * len(x))), quality_rules.consistency(share, 5)
    for _ in range(starts):
        inner, last = x[r.choice(len(x), 30, replace=False)], np.inf
        while True:
            c, v = inner.mean(0), np.cov(inner.T, bias=True) * factor + floors
            det = np.linalg.slogdet(v)[1]
            if det > last - 1e-9:
                break
            last, inner = det, x[np.argsort(np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(v), x - c))[:h]]
        if best is None or last < best[0]:
            best = last, c, v
    return best[1:]


def test_estimates_like_a_plain_search(spark):
    r = np.random.default_rng(7)
    mix = r.normal(size=(5, 5))
    inner = {g: r.normal(size=(n, 5)) @ mix + k for k, (g, n) in enumerate({"a": 900, "b": 500}.items())}
    groups = {g: np.vstack([x, r.normal(12, 0.3, (len(x) // 6, 5))]) for g, x in inner.items()}
    rows = [(g, *map(float, x)) for g, xs in groups.items() for x in xs]
    vectors = spark.createDataFrame(rows, "group string, x0 double, x1 double, x2 double, x3 double, x4 double")
    for e in quality_rules.estimates(vectors, Scratch(spark, "mcd")).collect():
        x = groups[e["group"]]
        c, v = plain_mcd(x)
        low = np.array([[e[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert e["rows"] == len(x)
        far = lambda c, v: np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(v), x - c)
        mine, best = far(np.array([e[f"c{j}"] for j in range(5)]), low @ low.T), far(c, v)
        assert np.linalg.slogdet(low @ low.T)[1] < np.linalg.slogdet(v)[1] + 0.3
        assert np.corrcoef(mine, best)[0, 1] > 0.99
        limit = quality_rules.chi2_quantile(0.9999, 5)
        planted = np.arange(len(x)) >= len(inner[e["group"]])
        assert (mine[planted] > limit).all() and (mine[~planted] <= limit).mean() > 0.97


def test_rules_judge_small_groups_and_odd_ids(spark):
    """Junk alone in its group is measured by its language; NULL and repeated ids count as rows; extra columns do no harm."""
    rows = [(k % 350 or None, t, "en", "a", 1) for k, t in enumerate(prose(400, 11, 300))]
    junk = [(5000 + k, " ".join(x + "$$$" for x in t.split()), "en", f"s{k}", 1) for k, t in enumerate(prose(9, 12, 600)) if len(t.split()) >= 50]
    other = [(6000 + k, t, None, None, 1) for k, t in enumerate(prose(3, 13, 300)) if len(t.split()) >= 50]
    df = docs(spark, rows + junk + other).withColumns({c: F.lit("x") for c in ("group", "d2", "x0", "_words", "rows", "kept")})
    got = quality_rules.judge(df).collect()
    assert len(got) == len(rows + junk + other)
    assert all((x["d2"] is None) == x["base_failed"] and x["kept"] is not None for x in got)
    assert junk and not any(x["kept"] for x in got if 5000 <= (x["doc_id"] or 0) < 6000)
    assert all(x["kept"] for x in got if not x["base_failed"] and not 5000 <= (x["doc_id"] or 0) < 6000)


def test_chi_square():
    assert abs(quality_rules.chi2_quantile(0.975, 5) - 12.832501994) < 1e-6
    assert abs(quality_rules.gamma_p(2.5, 1.0) - 0.15085496391539) < 1e-9


def test_url_rules_like_all_rules(spark):
    r = random.Random(4)
    urls = [None, "", "no scheme", "http://", "http://COM/en/", "x://a.com/en", "http://example.com/en/7?x", "https://a.example.net/de/8#f", "https://spam-farm.org/x", "http://net/de/", "http://xnet/de/1", "http://a.com?/en/"]
    urls += [f"http://{r.choice(['', 'a.', 'x-b.'])}{r.choice(['example.com', 'example.net', 'foo.org', 'com', 'casino.net'])}/{r.choice(['en', 'de', 'es'])}/{r.randint(1, 99)}" for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.SITES + url_filter.PATTERNS
    for x in url_filter.judge(df).collect():
        u = x["url"] or ""
        rest = u[u.index("://") + 3 :] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({65 + k: 97 + k for k in range(26)})
        hits = [q for q in rules if re.search(q.pattern, host + path)]
        best = max((q for q in hits if q.site), key=lambda q: len(q.name), default=None)
        assert (x["host"], x["path"], x["rule"]) == (host, path, best and best.name)
        assert x["verdict"] == (best.verdict if best else "block" if hits else "allow")


def test_restoring():
    text = " ".join(prose(200, 3)) + " you idiot and moron scum stupid trash " * 40
    x = toxicity._CLASS[np.frombuffer(text.encode(), np.uint8)].astype(np.int64)
    costs = toxicity.trigram_costs(np.bincount(x[:-2] * 841 + x[1:-1] * 29 + x[2:], minlength=29**3))
    r = toxicity.Restorer(costs)
    for written, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("s t u p i d", "stupid"), ("i.d.i.o.t", "idiot"), ("tr@sh", "trash"), ("scuuuum", "scum")):
        assert r.text(f"you {written} there") == f"you {meant} there"
    assert r.text("plain words, 12.5 and 7!") == "plain words, 12.5 and 7!"
    raw = ["nothing here", "a 1d10t", "", "x"]
    for _, _, data, off in chunks(pa.array(raw)):
        new, at = r.chunk(data, off)
        assert [new.tobytes()[i:j].decode() for i, j in zip(at, at[1:])] == ["nothing here", "a idiot", "", "x"]


class Seen(toxicity.Restorer):
    """Notes the spans that reach the lattice."""

    def __init__(self):
        self.spans = []

    def read(self, span):
        self.spans.append(span)
        return span

    def of(self, text):
        self.spans.clear()
        for _, _, data, off in chunks(pa.array([text])):
            self.chunk(data, off)
        return self.spans


def every_reading(span, costs):
    """The cheapest reading among all paths of the lattice, by enumeration."""
    runs = [len(re.match(re.escape(c) + "+", span[i:]).group()) for i, c in enumerate(span)]
    best = (float("inf"), "")

    def walk(i, state, cost, text):
        nonlocal best
        if i == len(span):
            total = cost + costs[state[0], state[1], 0]
            best = min(best, (total, text))
            return
        for j, x, channel in toxicity.edges(span, i, runs[i]):
            if x:
                code = ord(x) - 96 if "a" <= x <= "z" else 0 if x.isspace() else 27 if ord(x) > 127 else 28
                walk(j, (state[1], code), cost + channel + costs[state[0], state[1], code], text + x)
            else:
                walk(j, state, cost + channel, text)

    walk(0, (0, 0), 0.0, "")
    return best


def cost_of(span, text, costs):
    """The cheapest path that reads text."""
    kept = [float("inf")]
    runs = [len(re.match(re.escape(c) + "+", span[i:]).group()) for i, c in enumerate(span)]

    def walk(i, state, cost, at):
        if i == len(span):
            if at == len(text):
                kept[0] = min(kept[0], cost + costs[state[0], state[1], 0])
            return
        for j, x, channel in toxicity.edges(span, i, runs[i]):
            if x and text.startswith(x, at):
                code = ord(x) - 96 if "a" <= x <= "z" else 0 if x.isspace() else 27 if ord(x) > 127 else 28
                walk(j, (state[1], code), cost + channel + costs[state[0], state[1], code], at + len(x))
            elif not x:
                walk(j, state, cost + channel, at)

    walk(0, (0, 0), 0.0, 0)
    return kept[0]


def test_decoding_finds_the_cheapest_of_all_paths():
    r = random.Random(11)
    signs = "abeilost" * 2 + "013457@$!|+()-. /\\_v<" + "é"
    for n in range(400):
        costs = np.random.default_rng(n).exponential(2.0, (toxicity.SYMBOLS,) * 3) + 0.01
        span = "".join(r.choice(signs) * r.choice([1, 1, 1, 2, 3]) for _ in range(r.randint(1, 4)))[:7]
        total, _ = every_reading(span, costs)
        assert abs(cost_of(span, toxicity.decode(span, costs), costs) - total) < 1e-9, span


def test_long_spans_are_not_kept():
    restorer = toxicity.Restorer(np.ones((toxicity.SYMBOLS,) * 3))
    restorer.read("a" * 65)
    restorer.read("a" * 64)
    assert list(restorer.seen) == ["a" * 64]


def test_toxicity_chunk_looks_where_the_expression_does():
    for written in ("m 0 r 0 n", "1 d 1 0 t", "i--d--i--o--t", "i  d  i  o  t", "a$$"):
        assert Seen().of(f"you {written}") == [m.group() for m in toxicity.SUSPECT.finditer(f"you {written}")] != []


@pytest.mark.parametrize("written", [
    *[f"wo{c}rd" for c in toxicity.LOOKS], *[f"{c}ord" for c in toxicity.LOOKS], *[f"wo{c}rd" for c in toxicity.PAIRS], *[f"{c}ord" for c in toxicity.PAIRS if c != "vv"],
    *[f"wor{c}" for c in toxicity.PAIRS], *[c.join("idiot") for c in toxicity.SEPARATORS], "wor#", "wor%", "idio7", "a s s", "i.d-i_o t", "idiiot",
])
def test_toxicity_whole_channel_reaches_the_lattice(written):
    assert Seen().of(f"you {written}") == [written]


def test_toxicity_spans_stay_linear():
    start = time.monotonic()
    for text in ("/\\" * 20_000, "|_" * 20_000, "ab" * 20_000, "a." * 20_000 + "é", "(" * 20_000, "$a" * 20_000 + "!" * 20_000):
        Seen().of(text)
    assert time.monotonic() - start < 20


def test_long_spans_are_read_whole():
    x = toxicity._CLASS[np.frombuffer(("you are a stupid moron " * 50).encode(), np.uint8)].astype(np.int64)
    costs = toxicity.trigram_costs(np.bincount(x[:-2] * 841 + x[1:-1] * 29 + x[2:], minlength=29**3))
    assert toxicity.Restorer(costs).text(".".join("stupid" * 60)) == "stupid" * 60  # 719 signs
    start = time.monotonic()
    for text in ("x" * 30_000, "w " * 20_000, "$" * 20_000 + "a", "a." * 20_000):
        toxicity.Restorer(costs).text(text)
    assert time.monotonic() - start < 60


def labelled(spark):
    good, bad = prose(300, 21), prose(300, 22)
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(good)] + [(1000 + k, t + " $$$ junk!! idiot " * 3, "en", "a", 1) for k, t in enumerate(bad)]
    marks = [(k, 1, 0) for k in range(300)] + [(1000 + k, 0, 1) for k in range(300)] + [(None, 1, 0), (5, None, None), (7, 1, 0)]
    return docs(spark, rows + ODD[:3]), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifiers_on_held_out_rows(spark, module):
    df, labels = labelled(spark)
    got = [x for x in module.query(spark, df, labels).collect()]
    assert len(got) == 603 and all(0 <= x["score"] <= 1 for x in got)
    m, rest = (5, 0) if module is quality_classifier else (3, 1)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % m == rest) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] not in (1, 2, 3)]
    right = [x["predicted"] == int((x["doc_id"] < 1000) == (module is quality_classifier)) for x in held]
    assert sum(right) / len(right) > 0.95
    empty = labels.where("false")
    assert {x["score"] for x in module.query(spark, df, empty).collect()} == {0.5}
    assert module.query(spark, docs(spark, []), labels).count() == 0


def test_ftrl_rows_pack_without_loss():
    r = np.random.default_rng(2)
    for n, top in ((0, 10), (1, 1 << 20), (900, 1 << 18), (5, 1 << 24)):
        at, x = np.unique(r.integers(0, top, n)), r.random(1)
        for values in (np.repeat(x, len(at)), r.random(len(at)), np.log1p(r.integers(1, 5, len(at)))):
            a, b = ftrl.unpack_row(ftrl.pack_row(at, values))
            assert a.tolist() == at.tolist() and b.tolist() == values.astype("<f4").tolist()
    at, x = np.arange(70_000), r.random(70_000)
    assert ftrl.unpack_row(ftrl.pack_row(at, x))[1].tolist() == x.astype("<f4").tolist()


def test_ftrl_like_a_dense_model(spark):
    """Every update on dense vectors, coordinate by coordinate, gives the weights that fit learns in a task."""
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(prose(60, 44, 12))]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    ids = ftrl.training_ids(labels, "quality", 5, 0, 1000)
    bits, rate = 6, {"alpha": 0.5, "l1": 0.05, "l2": 0.1}
    got = ftrl.fit(docs(spark, rows), ids, lambda data, off: quality_classifier.features(data, off, bits), bits, epochs=2, **rate)
    z, n, size = [0.0] * 65, [0.0] * 65, 64

    def weight(i):
        if i == size:
            return -z[i] / ((1 + n[i] ** 0.5) / 0.5)
        return 0.0 if abs(z[i]) <= 0.05 else -(z[i] - np.sign(z[i]) * 0.05) / ((1 + n[i] ** 0.5) / 0.5 + 0.1)

    order = [(r["doc_id"], r["y"]) for r in ids.orderBy("turn", "doc_id").collect()]
    for _ in range(2):
        for i, y in order:
            for _, _, data, off in chunks(pa.array([rows[i][1]])):
                ptr, at, x = quality_classifier.features(data, off, bits)
            dense = np.zeros(65)
            dense[at] = x.astype("<f4")
            dense[size] = 1.0
            w = [weight(k) for k in range(65)]
            p = 1 / (1 + np.exp(-float(np.dot(w, dense))))
            for k in range(65):
                g = (p - y) * dense[k]
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / 0.5 * w[k]
                n[k] += g * g
    assert np.abs(got - np.array([weight(k) for k in range(65)])).max() < 1e-5


def test_ftrl_learns_a_sign():
    m = ftrl.Ftrl(4)
    for k in range(200):
        m.learn(np.array([k % 2]), np.array([1.0]), k % 2)
    w = m.weights()
    assert w[1] > 0 > w[0]


def lm_brute(texts, target, counted):
    """Losses of each text under models of all other texts: (background, target)."""
    def grams(i):
        w = texts[i]
        return collections.Counter(w), collections.Counter(zip(["<s>", *w], w)), collections.Counter(["<s>", *w] if w else [])

    own = {i: grams(i) for i in texts}
    out = {}
    vocabulary = len({w for i in texts if i in counted for w in texts[i]})
    for i, w in texts.items():
        both = []
        for side in (counted, counted & target) if counted & target else (counted, counted):
            rest = [own[j] for j in side if j != i]
            n1, n2, c = (sum((x[k] for x in rest), collections.Counter()) for k in range(3))
            total = sum(n1.values())
            uni = lambda x: (n1[x] + 0.5) / (total + 0.5 * (vocabulary + 1))  # noqa: E731, B023
            both.append(-sum(np.log((n2[a, b] + 4 * uni(b)) / (c[a] + 4)) for a, b in zip(["<s>", *w], w)))
        out[i] = (len(w), *both)
    return out


@pytest.mark.parametrize("targets", [2, 0])
def test_lm_like_brute_force(spark, targets):
    """Texts of odd kinds, repeated texts, NULL and repeated ids, rows that do not count, no target text."""
    rows = ODD[:6] + [(100 + k, t, "en", "a", 1) for k, t in enumerate(prose(60, 31, 40))] + [(300, prose(1, 31, 40)[0], "en", "a", 1), (None, "it it", "en", "a", 1), (100, "again", "en", "a", 1)]
    keyed = [(k, *r) for k, r in enumerate(rows)]
    df = spark.createDataFrame(keyed, "k long, " + DOCS).repartition(3)
    flags = df.select("k", "doc_id", F.lit("clash").alias("lm_"), F.col("text"), (F.col("k") % 4 < targets).alias("target"), (F.col("k") % 7 != 3).alias("counted"))
    texts = {k: re.findall(WORD, (t or "").translate({65 + j: 97 + j for j in range(26)})) for k, _, t, *_ in keyed}
    want = lm_brute(texts, {k for k in texts if k % 4 < targets}, {k for k in texts if k % 7 != 3})
    got = lm_scoring.score(flags, counted="counted")
    assert got.columns == ["k", "doc_id", "lm_", "lm"]
    got = {x["k"]: x["lm"] for x in got.collect()}
    assert set(got) == set(want)
    for k, (n, background, target) in want.items():
        assert got[k]["n_words"] == n
        assert abs(got[k]["background"] - background) < 1e-6 * (1 + n) and abs(got[k]["target"] - target) < 1e-6 * (1 + n)


def test_lm_query_on_odd_tables(spark):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in lm_scoring.query(spark, docs(spark), labels).collect()}
    assert len(got) == len(ODD) and got[1]["score"] == got[2]["score"] == got[3]["score"] == 0.0 and got[9]["n_words"] == 20000
    assert lm_scoring.query(spark, docs(spark, []), labels).count() == 0
    assert {x["score"] for x in lm_scoring.query(spark, docs(spark), labels.where("false")).collect()} == {0.0}


def test_lm_tells_texts_that_occur_twice(spark):
    """Every pair counts, however rare: a text whose copy is elsewhere has a far smaller background loss."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(60)) for _ in range(300)]
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)] + [(1000 + k, t, "en", "a", 1) for k, t in enumerate(texts[:40])]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(100, 200)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["background_nats"] / x["n_words"] for x in lm_scoring.query(spark, docs(spark, rows), labels).collect()}
    assert max(got[k] for k in range(40)) < min(got[k] for k in range(40, 300))


@pytest.mark.parametrize("limit", [1 << 10, 1 << 18, 2 << 20])
def test_chunk_size_changes_nothing(limit, monkeypatch):
    """Sets and features of chunks of any size, and of texts longer than the blocks that hashes takes."""
    import motorlens.llm.shared as shared

    texts = pa.array([r[1] for r in ODD] + prose(300, 3) + [" ".join(prose(200, 4))])
    def all_of(size, block):
        monkeypatch.setattr(shared, "CHUNK", block)
        sets, rows = [], []
        for _, _, data, off in chunks(texts, size):
            sets += [s.tobytes() for s in ngram_join.shingle_sets(data, off)]
            ptr, at, x = quality_classifier.features(data, off)
            rows += [(at[i:j].tobytes(), np.round(x[i:j], 9).tobytes()) for i, j in zip(ptr, ptr[1:])]
        return sets, rows

    assert all_of(limit, 1 << 18) == all_of(1 << 16, 500)


def test_token_ids_of_every_letter_before_a_sign():
    """Words that end in any letter, also one that the normaliser decomposes, with a sign behind it."""
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    model, own = Tokenizer.from_file(path), token_files.WordEncoder(path, "<u2")
    texts = [f"ab{chr(c)}. {chr(c)}," for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(texts), 20_000):
        for t, e in zip(texts[lo : lo + 20_000], model.encode_batch_fast(texts[lo : lo + 20_000], add_special_tokens=False)):
            assert np.frombuffer(own.ids(t.encode()), "<u2").tolist() == e.ids


def test_pipeline_stages_are_their_operators(spark, tmp_path):
    import corpus_pipeline

    df, labels = labelled(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at, before = df, df.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == before
    last = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in last.collect()}
    assert ids and len([i for i in ids if i >= 1000]) < 15


CLASHES = "score predicted held_out kept keep_id group_size sha digest bytes low high n bin group parent rows x0 c0 d2 size taken target start n_tokens ids ids_crc32 component_id n_shingles words label part row pos _words _copies _copy _mine _nth _text_sha256 _quality_score rule verdict host path".split()


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """NULL ids, one id for several rows, columns called like the operators' own."""
    root = tmp_path_factory.mktemp("odd")
    df, labels = labelled(spark)
    odd = docs(spark, [(None, "no id at all", "en", "a", 1), (None, None, None, None, None), (7, "twice", "en", "a", 1), (7, "twice", "en", "a", 1), (7, "another text of seven", None, "b", 1), *ODD[3:]])
    df = df.unionByName(odd).withColumns({c: F.lit("x") for c in CLASHES})
    df.repartition(3).write.parquet(str(root / "documents.parquet"))
    labels.withColumns({c: F.lit(5) for c in ("score", "text", "predicted", "_quality_score")}).write.parquet(str(root / "labels.parquet"))
    pages = spark.createDataFrame([(1, "http://a.net/de/9"), (None, None), (1, "x")], "page_id long, url string").withColumns({c: F.lit("x") for c in CLASHES})
    pages.write.parquet(str(root / "pages.parquet"))
    vectors = [(None, [0.5] * 16, None), (1, [0.25] * 16, 1), (1, [0.25] * 16, None), (2, None, 1), (3, [float("nan")] + [0.0] * 15, 1), (4, [None] + [0.0] * 15, 1), (5, [1.0] * 15, 2), (6, [float("inf")] * 16, 2), (7, [-0.001] * 16, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in CLASHES if c != "label"} | {c: F.lit(1) for c in ("code", "error", "_coded", "s0", "entry")}).write.parquet(str(root / "embeddings.parquet"))
    return str(root), df.count()


@pytest.mark.parametrize("name", sorted(llm_queries.queries()))
def test_odd_rows_and_clashing_columns(spark, odd_tables, name):
    root, rows = odd_tables
    df = llm_queries.queries()[name](spark, root)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    expected = {"op5_url_filter": 3, "op11_filter_audit": 600 * len({r["lang"] or "" for r in spark.read.parquet(f"{root}/documents.parquet").select("lang").distinct().collect()}), "op13_vector_codes": 5}
    assert len(got) == expected.get(name, rows)


def test_pipeline_stages_like_brute_force(spark, odd_tables):
    """What exact dedup, the near join and the mix keep, each judged on its own input."""
    import corpus_pipeline

    root, _ = odd_tables
    stages = dict(corpus_pipeline.STAGES)
    words = prose(60, 31, 60)
    rows = [(k, words[k % 50], "en", "ab"[k % 2], 1) for k in range(90)] + [(200 + k, words[k] + " tail", "en", "a", 1) for k in range(40)] + ODD[:1]
    df = docs(spark, rows).withColumns({c: F.lit("x") for c in CLASHES})
    exact = stages["exact dedup"](spark, df, root)
    last = {}
    for i, t, *_ in rows:
        last[t or ""] = max(i, last.get(t or "", i))
    assert exact.columns == df.columns and sorted(x["doc_id"] for x in exact.collect()) == sorted(last.values())
    near = stages["n-gram Jaccard join"](spark, exact, root)
    ids = sorted(last.values())
    text = {i: t for t, i in last.items()}
    sets = {}
    for i in ids:
        w = re.findall(WORD, text[i].lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    kept = sorted(set(least.values()))
    assert len(kept) < len(ids)
    assert near.columns == df.columns and sorted(x["doc_id"] for x in near.collect()) == kept
    mix = stages["source mix"](spark, near, root)
    copies = {x["doc_id"]: x["taken"] // max(1, x["size"]) for x in source_mix.query(spark, near).collect()}
    assert mix.columns == df.columns
    got = collections.Counter(x["doc_id"] for x in mix.collect())
    assert set(got) <= set(kept) and all(abs(got[i] - copies[i]) <= 1 for i in kept)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), root).count() == 0


# ---------------------------------------------------------------- filter audit


def audit_brute(rows, labels):
    """Every order of filters applied left to right, one document after the other."""
    import itertools

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    bad = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(WORD, t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        bad.append({c for c, f in fails.items() if f})
    out = {}
    for part in {r[2] or "" for r in rows}:
        docs_ = [(r[0], b) for r, b in zip(rows, bad) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = list(docs_)
            for step, c in enumerate(order, 1):
                here = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                fails = [d for d in docs_ if c in d[1]]
                gone = sum(bool(d[1] & set(order[: step - 1])) for d in fails)
                out[part, "".join(order), step] = [len(left), len(here), gone, sum(d[1] == {c} for d in docs_), sum(d[0] in good for d in here), sum(d[0] in toxic for d in here)]
    for part, order, step in list(out):
        c = order[step - 1]
        out[part, order, step].append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == c))
    return {k: tuple(v) for k, v in out.items()}


AUDITED = [
    (1, "a " * 300, "en"), (2, "a " * 300, None), (3, None, ""), (4, "", None), (5, "Loud WORDS $ here", "en"), (5, "Loud WORDS $ here", "en"), (6, "Loud WORDS $ here", "de"), (None, "Loud WORDS $ here", "de"),
    (7, " ".join(f"w{k}" for k in range(250)), "en"), (8, " ".join(f"w{k}" for k in range(250)), "en"), (9, "Ünï 漢字 " * 120, "en"), (10, "X" + "y" * 32, "de"), (11, "é" * 64 + "tail", "de"), (12, "é" * 64 + "tails", "de"),
]


@pytest.mark.parametrize("same", [False, True])
def test_audit_like_every_order(spark, monkeypatch, same):
    """Also if all texts of one length are in one class."""
    if same:
        monkeypatch.setattr(filter_audit, "classes", lambda text: [F.char_length(text).cast("long").alias(f"k{i}") for i in range(len(filter_audit.BLOCKS) + 2)])
    rows = [*AUDITED, (20, "Loud WORDS % here", "en"), (21, "Loud WORDS % here", "en"), *((100 + k, t, "de") for k, t in enumerate(prose(60, 4, 400)))]
    labels = [(1, 1, 0), (2, 1, 1), (5, 1, None), (5, 0, 1), (7, 1, 0), (8, 1, 0), (None, 1, 1), (999, 1, 1), (6, None, 1)]
    df, l = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit.query(spark, df, l).collect()}
    assert got == audit_brute(rows, labels)
    assert filter_audit.query(spark, df.limit(0), l).count() == 0


# ---------------------------------------------------------------- licences


def test_expressions_are_ordered_and_evaluated():
    whole = lambda t: license_scan.evaluate(license_scan.postfix(t)) if license_scan.postfix(t) else None
    assert whole(" MIT") == (3, ["mit"], "mit")
    assert whole("MIT OR GPL-3.0-only AND Apache-2.0") == (3, ["mit", "gpl", "apache"], "(mit or (gpl-3.0-only and apache-2.0))")
    assert whole("(MIT or GPL-3.0+) and apache-2.0") == (3, ["mit", "gpl", "apache"], "((mit or gpl-3.0+) and apache-2.0)")
    assert whole("GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause") == (2, ["gpl", "bsd"], "((gpl-2.0-or-later with classpath-exception-2.0) and bsd-3-clause)")
    assert whole("GPL-2.0 AND Proprietary-Thing") == (0, ["gpl", "proprietary-thing"], "(gpl-2.0 and proprietary-thing)")
    assert whole("MIT OR") == whole("MIT OR (") == whole("(MIT") == whole("MIT) OR GPL-2.0") == whole("MIT. And so on") == (3, ["mit"], "mit")
    assert whole("MIT and more words") == (0, ["mit", "more"], "(mit and more)")
    assert whole("") is whole("( AND MIT") is whole("OR") is whole("--") is None


def expression_brute(text):
    """A recursive reader of complete expressions: the least of `and`, the best of `or`."""
    tokens = re.findall(r"[()]|[A-Za-z0-9.+-]+", text)

    def either(at):
        value, at = both(at)
        while at < len(tokens) and tokens[at].lower() == "or":
            other, at = both(at + 1)
            value = max(value, other)
        return value, at

    def both(at):
        value, at = single(at)
        while at < len(tokens) and tokens[at].lower() == "and":
            other, at = single(at + 1)
            value = min(value, other)
        return value, at

    def single(at):
        if tokens[at] == "(":
            value, at = either(at + 1)
            return value, at + 1
        value = license_scan.FREEDOM.get(license_scan.family(tokens[at]), 0)
        if at + 2 < len(tokens) and tokens[at + 1].lower() == "with":
            return (2 if value == 1 else value), at + 3
        return value, at + 1

    return either(0)[0]


def test_expressions_like_a_recursive_reader():
    r = random.Random(9)

    def made(depth):
        if depth == 0 or r.random() < 0.3:
            name = r.choice(["MIT", "GPL-2.0-only", "LGPL-2.1+", "Apache-2.0", "Unknown-1.0", "CC-BY-NC-4.0"])
            return name + (" WITH Some-exception" if r.random() < 0.2 else "")
        inner = f" {r.choice(['AND', 'or', 'OR', 'and'])} ".join(made(depth - 1) for _ in range(r.randint(2, 3)))
        return f"({inner})" if r.random() < 0.5 else inner

    for _ in range(2000):
        text = made(3)
        assert license_scan.evaluate(license_scan.postfix(text))[0] == expression_brute(text), text


def test_licence_places_like_a_plain_search(spark):
    r = random.Random(5)
    pieces = ["MIT", "License", "mit license", "Apache-License", "general public", "GENERAL PUBLIC LICENSE", "lesser", "license", "é", "cc by", "nc", "x1", ".", "\n", "||", "\u00a0"]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(400)]
    texts += ["SPDX-License-Identifier: (MIT OR GPL-2.0-only) */\nmore", "x\nspdx license identifier : Apache-2.0\r\nMIT", "License-Expression MIT", "license expression: BSD-3-Clause", "SPDX-License-Identifier:", None, "", "mit license " * 20000, "Mit" + "\x00" + "License", "mitlicense", "mit\u00a0license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("labels", "n_words", "row", "got", "spans")})
    got = {x["doc_id"]: x for x in license_scan.query(spark, df).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        found = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()] if len(w) < 5000 else [(i, "mit") for i in range(0, len(w), 2)]
        x = got[k]
        assert (x["n_words"], x["n_base"]) == (len(w), len(found))
        assert (x["first_word"], x["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert x["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert set(x["base_labels"].split(",")) <= set(x["labels"].split(",")) or not x["base_labels"]
        assert 0 <= x["score"] <= 1 and (x["score"] > 0) == bool(x["labels"])
    assert [got[400 + k]["labels"] for k in range(5)] == ["gpl,mit", "apache", "", "bsd", ""]
    assert got[400]["expressions"] == ["(mit or gpl-2.0-only)"] and got[400]["freedom"] == 3
    spans = license_scan.scan(df.where("doc_id < 400").select("text")).select("text", "labels", F.explode("spans").alias("s")).collect()
    assert all(s["s"]["label"] in s["labels"].split(",") for s in spans)
    assert license_scan.query(spark, df.limit(0)).count() == 0


# ---------------------------------------------------------------- vector codes


def codes_brute(rows, parts=16, entries=64, rounds=2, scale=256):
    import math
    from fractions import Fraction

    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    cut = [[[math.floor(Fraction(x) * scale) for x in r[1]][p * len(r[1]) // parts : (p + 1) * len(r[1]) // parts] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    best = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[best(p, c[p])[1]].append(c[p])
            for k, g in groups.items():
                new[p][k] = [sum(v) // len(g) for v in zip(*g)]
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for r, c in zip(kept, cut):
        near = [best(p, c[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), r[2], sha))
    totals = collections.Counter()
    for _, _, e, label, _ in out:
        totals[label] += e
    return [(i, code, e, totals[label], sha) for i, code, e, label, sha in out]


@pytest.mark.parametrize("size", [0.3, 2e6, 1e9])
def test_codes_like_brute_force(spark, size):
    """Also where distances and sums need more than 64 bits."""
    r = random.Random(2)
    rows = [(i, [float(np.float32(r.gauss(0, size))) for _ in range(32)], r.choice([None, 1, 2])) for i in range(150)]
    rows += [(7, list(rows[3][1]), 1), (None, list(rows[5][1]), None), (200, None, 1), (201, [float("nan")] * 32, 1), (202, [None] + [0.0] * 31, 2), (203, [-1e-9] * 32, None), (204, [0.0] * 31 + [float("-inf")], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = sorted(map(tuple, vector_codes.query(spark, df).collect()), key=repr)
    most = (1 << 63) - 1
    want = sorted(((i, c, e if e <= most else None, t, sha) for i, c, e, t, sha in codes_brute(rows)), key=repr)
    if size < 1e9:
        assert got == want
    else:
        assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]


def test_codes_of_small_and_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vector_codes.query(spark, spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.query(spark, spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    rows = [(1, [0.5] * 16, 1), (2, [0.25] * 16, 1), (3, [0.5] * 20, 1), (4, [], 1), (5, [1e300] * 16, 2)]
    got = {x["vec_id"]: x for x in vector_codes.query(spark, spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["code"] == "00" * 16 and got[2]["code"] == "01" * 16 and got[5]["code"] == "02" * 16 and got[5]["error"] == 0
    assert got[3]["code"] is None and got[4]["code"] is None and got[1]["label_error"] == 0
    out, books = vector_codes.compress(spark.createDataFrame([(1, [1.0] * 18, 1)], schema), parts=4)
    assert books.shape == (4, 1, 5) and out.first()["code"] == "00000000"
