"""Each operator against a plain version, on sf0.001 and on awkward rows."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.llm import blocks, bpe, chat, components, decontaminate, jaccard, pages, quality_model, quality_rules, repeats, templates, toxicity
from veilspark.llm.queries import QUERIES, vocabulary_text

SMALL = "/root/testdata/sf0.001"
SPACE = "\x20\x09-\x0d"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
PASSAGE = " ".join(f"shared{k}" for k in range(120))
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, LONG), (7, LONG), (8, PASSAGE + " tail of its own"), (9, "head " + PASSAGE),
    (10, "é漢字𝔘 ½  x"), (10, "é漢字𝔘 ½  x"), (11, "<|endoftext|> x<|endoftext|>"), (None, "no id here"), (12, "a" * 3000), (13, "ab " * 900), (14, "x\ny\nx\ny")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Rows with nulls, empty and very long texts, repeats, and columns named as the operators name theirs."""
    rows = [(i, t, "s", 1, "k") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, score int, id string")


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.limit(0)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def plain_words(text):
    return re.findall(f"[^{SPACE}]+", text)


# -- BPE --------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_tokenizers_library(spark, small, awkward, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (small, awkward):
        want = Counter((i, tuple(reference.encode(t, add_special_tokens=False).ids)) for i, t in texts(df))
        encoded = bpe.encode(df, vocabulary_text())
        assert Counter((r[0], tuple(r[2])) for r in encoded.collect()) == want
        assert Counter((r[0], r[1]) for r in bpe.decode(encoded, vocabulary_text()).collect()) == Counter(texts(df))
    assert bpe.encode(nothing, vocabulary_text(), digest=True).count() == 0


def test_bpe_merges_odd_characters():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    vocab = bpe.Vocabulary(vocabulary_text())
    rng = np.random.default_rng(3)
    odd = ["".join(map(chr, range(0x700))), " ".join(map(chr, range(0x250))), "\x1c a \x1f\x85 b​᠎", "it's WE'LL don't", "ab" * 700]
    odd += ["".join(chr(rng.integers(32, 0x3000)) for _ in range(120)) for _ in range(60)]
    for text, ids in zip(odd, vocab.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
        assert vocab.decode(np.frombuffer(ids, "<u4")) == text
    with pytest.raises(ValueError):
        vocab.decode(np.array([10**6]))


# -- Quality rules ----------------------------------------------------------------------------------------------------


def plain_quality(text):
    words, lines = plain_words(text), [x for x in text.split("\n")]
    worded = [x for x in lines if plain_words(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lost = total = failed = 0
    for x in worded:
        own = plain_words(x)
        size = sum(map(len, own))
        bad = 100 * len(re.findall(r"[#*$%&|<>{}=~^_\\!]", x)) > 10 * size
        bad |= len(re.findall("[|>]", x)) >= 2 and 4 * len(re.findall("[|>]", x)) >= len(own)
        bad |= any(p in re.sub("[A-Z]", lambda m: m[0].lower(), x) for p in quality_rules.BOILERPLATE)
        bad |= 100 * sum(a == b for a, b in zip(own, own[1:], strict=False)) > 40 * len(own)
        total, lost, failed = total + size, lost + size * bad, failed + bad
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), total, len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(covered), base, not base and 100 * lost <= 30 * total, len(worded), failed)


def test_quality_rules_equal_a_plain_version(small, awkward, nothing):
    for df in (small, awkward):
        want = Counter((i, *plain_quality(t)) for i, t in texts(df))
        assert Counter(tuple(r) for r in quality_rules.clean(df, with_text=False).collect()) == want
    assert quality_rules.clean(nothing).count() == 0


def test_quality_rules_remove_failed_lines(spark):
    good = "This is a plain sentence of a text that nobody would call boilerplate at all, is it?"
    text = f"{good}\nHome | About | Contact | Help\n{good[::-1]}\n*** ### $$$\n\nAll Rights Reserved by someone else entirely here"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = quality_rules.clean(df, carry=True).first()
    assert row["clean_text"] == f"{good}\n{good[::-1]}\n" and (row["n_lines"], row["n_failed_lines"]) == (5, 3)


# -- Decontamination --------------------------------------------------------------------------------------------------


def plain_hits(docs, items, window):
    fold = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = defaultdict(set)
    for item, t in items:
        w = fold(t or "")
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    sizes = {len(x) for x in windows}
    for i, t in docs:
        w, hit, found = fold(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        yield i, len(w), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("item_bytes", [decontaminate.ITEM_BYTES, 300])
def test_contamination_equals_a_plain_version(spark, small, awkward, nothing, item_bytes):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    extra = [(900, "one two"), (901, "two"), (902, None), (903, "--"), (904, PASSAGE[:200]), (905, PASSAGE[:200]), (None, "head"), (906, "a b a b a b a b a b a b"), (907, "w5x5 w6x6 w7x7")]
    items = bench.union(spark.createDataFrame(extra, "item_id long, text string"))
    named = [(r[0], r[1]) for r in items.collect() if r[0] is not None]
    frames = (small, awkward) if item_bytes > 1000 else (small,)
    for df in frames:
        got = decontaminate.contamination(df, items, item_bytes=item_bytes, with_text=True, carry=True).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == Counter(plain_hits(texts(df), named, 10))
    clean = {r["doc_id"]: r["clean_text"] for r in got}
    hits = {r["doc_id"]: r["hits"] for r in got}
    for i, t in texts(df):
        if i is not None and not hits[i]:
            assert clean[i] == t
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(small, items.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_keeps_repeated_and_null_ids_apart(spark, awkward):
    items = spark.createDataFrame([(900 + k, f"{PASSAGE[60 * k:60 * k + 50]} and item {k}") for k in range(6)] + [(950, "no id here"), (951, "other text of"), (952, "w5x5 w6x6 w7x7")], "item_id long, text string")
    more = spark.createDataFrame([(8, "a second text with other text of the same id", "s", 1, "k"), (None, "x no id here y", "s", 2, "k"), (None, "z", "s", 3, "k")], awkward.schema)
    df, names = awkward.union(more), ["doc_id", "n_words", "n_hit", "items", "hits", "clean_text", "row"]
    one, several = (decontaminate.contamination(df, items, item_bytes=n, with_text=True, carry=True).select(names).collect() for n in (decontaminate.ITEM_BYTES, 300))
    assert len(one) == len(AWKWARD) + 3 and Counter(map(repr, several)) == Counter(map(repr, one))
    named = [(r[0], r[1]) for r in items.collect()]
    plain = decontaminate.contamination(df, items, item_bytes=300).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in plain) == Counter(plain_hits(texts(df), named, 10))


def test_removed_words_take_what_is_between():
    assert decontaminate.remove_words("Say: One, two! three four.".encode(), [(1, 3)]) == "Say: ! three four."


# -- Jaccard join -----------------------------------------------------------------------------------------------------


def plain_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = plain_words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append(frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[root(k)].append(i)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return Counter((i, len(sets[k]), low[root(k)]) for k, (i, _) in enumerate(rows))


def near_copies(n, size, seed, edits):
    rng = np.random.default_rng(seed)
    base = [f"t{seed}q{x}" for x in rng.integers(0, 500, size)]
    out = []
    for _ in range(n):
        words = list(base)
        for p in rng.integers(0, size, edits):
            words[p] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("rare", [32, 2])
def test_jaccard_equals_a_plain_version(spark, small, awkward, nothing, monkeypatch, rare):
    monkeypatch.setattr(jaccard, "RARE", rare)
    made = [t for s in range(12) for t in near_copies(9, 60 + 11 * s, s, 1 + s % 4)] + [f"notice of the site {k % 7} page {k % 3}" for k in range(40)]
    for rows in (texts(small), texts(awkward), list(enumerate(made))):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for words, percent in ((4, 85), (5, 80)):
            got = jaccard.similar(df, words=words, percent=percent)
            assert Counter(tuple(r) for r in got.collect()) == plain_components(rows, words, percent)
    assert jaccard.similar(nothing).count() == 0


def test_lines_are_read_once_by_the_parser(spark):
    df = spark.createDataFrame([(1, "a 2b c d\nx  y z w\n\nshort one"), (2, ""), (3, None)], "doc_id long, text string")
    parsed = templates.parse(df, "doc_id", "text")
    assert sorted((r["id"], r["pos"], r["line"]) for r in parsed.collect()) == [(1, 0, "a <*> c d"), (1, 1, "x y z w")]
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("split(") == 1


def rows_made_by_joins(df):
    """The most rows that a join of the plan makes."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        plans += [plan.children().apply(k) for k in range(plan.children().size())]
        if "Join" in plan.nodeName():
            most = max(most, plan.metrics().apply("numOutputRows").value())
    return most


def test_jaccard_makes_no_pairs_among_near_copies_that_do_not_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RARE", 8)
    rows = list(enumerate(near_copies(200, 200, 5, 6)))
    made, compared, further, verified = [], [], jaccard.Join.further_pairs, jaccard.Join.verified

    def watched(self, *args):
        pairs = further(self, *args)
        made.append(rows_made_by_joins(pairs))
        return pairs

    monkeypatch.setattr(jaccard.Join, "further_pairs", watched)
    monkeypatch.setattr(jaccard.Join, "verified", lambda self, pairs: [compared.append(pairs.count()), verified(self, pairs)][1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"))
        assert Counter(tuple(r) for r in got.collect()) == plain_components(rows, 4, 85)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(made) < 10 * len(rows) and sum(compared) < len(rows)


def test_jaccard_bitmaps_tell_long_sets_apart(spark):
    word = lambda k: f"w{k}"
    whole = [word(k) for k in range(1010)]
    rows = [(1, whole), (2, whole + [word(k) for k in range(5000, 5040)]), (3, whole[:600] + [word(k) for k in range(6000, 6410)]), (4, [word(k) for k in range(9000, 9900)])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "id long, text string")
    join = jaccard.Join(df, 4, 85)
    members = blocks.store(join.members("long"), "members")
    key = {r["id"]: r["key"] for r in members.collect()}
    assert sorted(len(r["bits"]) for r in members.collect()) == [32, 32, 32, 64]  # the second one is folded to compare
    pairs = spark.createDataFrame([(key[i], key[j]) for i in key for j in key if i < j], "a long, b long")
    left = {(r["a"], r["b"]) for r in join.likely(pairs, members).collect()}
    assert left == {(key[1], key[2])}


def test_rows_are_split_by_the_keys_that_are_looked_for(spark):
    rows = spark.range(20_000).selectExpr("nullif(id, 7) AS id", "'x' AS page", "id AS slot")
    found = blocks.store(spark.range(20_000).where("id % 100 = 3").selectExpr("id AS key").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS key")), "found")
    some, rest = blocks.split_by(rows, F.col("id"), F.col("key"), found)
    assert some.columns == rest.columns == rows.columns
    assert Counter(tuple(r) for r in some.unionByName(rest).collect()) == Counter(tuple(r) for r in rows.collect())
    assert rest.where("id % 100 = 3 OR id IS NULL").isEmpty() and some.count() < 200 + 20_000 / 8
    some, rest = blocks.split_by(rows, F.col("id"), F.col("key"), found.limit(0))
    assert some.isEmpty() and rest.count() == 20_000


def test_jaccard_prefix_asks_for_more_matches_where_postings_are_long():
    tokens = np.arange(100, dtype=np.uint64) << np.uint64(40)
    many = tokens[:95]
    m, rare, common = jaccard.prefix(tokens, 85, many, np.full(95, 1000), 0)
    assert m > 1 and len(rare) + len(common) == 100 - 85 + m
    m, rare, common = jaccard.prefix(tokens, 85, many[:0], np.zeros(0, np.int64), 0)
    assert (m, len(rare), len(common)) == (1, 16, 0)


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(7, k) for k in range(200, 260)]
    links = spark.createDataFrame(chain + star + [(5, 6), (6, 5), (None, 3)], "a long, b long")
    got = dict(components.components(links).collect())
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys([7, *range(200, 260)], 7), 5: 5, 6: 5}
    assert components.components(links.limit(0)).count() == 0


# -- Repeats ----------------------------------------------------------------------------------------------------------


def plain_removed(rows, length):
    seen = Counter(hash(t[i:i + length]) for _, t in rows for i in range(len(t) - length + 1))
    for i, t in rows:
        gone, upto = bytearray(len(t)), 0
        for k in range(len(t) - length + 1):
            if seen[hash(t[k:k + length])] > 1:
                gone[max(k, upto):k + length] = b"\1" * (k + length - max(k, upto))
                upto = k + length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        yield i, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("most", [repeats.MAX_CONTEXTS, 2])
def test_repeats_equal_a_plain_version(spark, small, awkward, nothing, monkeypatch, most):
    monkeypatch.setattr(repeats, "MAX_CONTEXTS", most)
    made = list(enumerate(near_copies(30, 300, 1, 3) + near_copies(6, 200, 2, 1) + [" ".join([PASSAGE, str(k), PASSAGE[:500]]) for k in range(4)]))
    for rows in (texts(small), [(i, t) for i, t in texts(awkward) if t != LONG], made):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = Counter(tuple(r) for r in repeats.remove_repeats(df, digest=True).collect())
        assert got == Counter(plain_removed([(i, t.encode()) for i, t in rows], 400))
    if most > 2:
        assert {r["n_removed"] for r in repeats.remove_repeats(awkward.where("doc_id in (6, 7)")).collect()} == {len(LONG)}
        row = repeats.remove_repeats(spark.createDataFrame(made, "doc_id long, text string")).where("doc_id = 36").first()
        text, at = made[36][1].encode(), 0
        for begin, end in row["spans"]:
            text = text[:begin - at] + text[end - at:]
            at += end - begin
        assert bytes(row["kept"]) == text
    assert repeats.remove_repeats(nothing).count() == 0


def test_interval_tree_gives_all_members_of_maximal_repeats():
    left = [b"xyz", b"xyz", b"xq", b""]
    right = [b"abcdef", b"abcd__", b"abcdef", b"zzzzzz"]
    found = {(i, l, r) for i, l, r, _ in repeats.maximal_repeats(left, right, 6)}
    assert found == {(0, 1, 6), (2, 1, 6), (0, 3, 4), (1, 3, 4)}


def test_groups_come_whole_and_one_after_the_other():
    sizes = [1, 5, 700, 2, 1, 1, 40, 300, 1]
    groups = np.repeat(np.arange(len(sizes)) - 4, sizes)
    for width in (1, 7, 64, 100, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(groups[k:k + width])], ["group"]) for k in range(0, len(groups), width)]
        tables = [t.column(0).to_numpy() for t in repeats.whole_groups(iter([*batches, batches[0].slice(0, 0)]))]
        assert np.array_equal(np.concatenate(tables), groups)
        assert all(a[-1] < b[0] for a, b in zip(tables, tables[1:], strict=False))
        assert max(map(len, tables)) <= max(sizes) + 2 * width
    assert list(repeats.whole_groups(iter([]))) == []


def test_a_passage_of_very_many_texts_makes_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join([*prose(rng, 80), PASSAGE[k % 9 * 20:], *prose(rng, 80)])) for k in range(90)]
    written, store = defaultdict(list), repeats.store

    def counted(df, name):
        out = store(df, name)
        written[name].append(out)
        return out

    monkeypatch.setattr(repeats, "store", counted)
    monkeypatch.setattr(repeats, "MAX_CONTEXTS", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in repeats.remove_repeats(df, digest=True).collect())
    assert got == Counter(plain_removed([(i, t.encode()) for i, t in rows], 400))
    contexts = written["contexts"][0].count()
    assert "hot" in written and max(t.count() for tables in written.values() for t in tables) < 20 * contexts
    assert written["covers"][0].count() == written["covers"][0].select("anchor", "context").distinct().count()


def test_repeats_gather_few_contexts_that_nobody_asked_for(spark):
    seats = spark.range(200_000).selectExpr("xxhash64(id) AS occurrence", "xxhash64(id, 1) AS `group`")
    flags = np.unpackbits(repeats._wanted(seats))
    assert 0 < flags.mean() < 0.07 and len(flags) <= repeats.MAX_BITS
    assert len(repeats._wanted(seats.limit(0))) and not repeats._wanted(seats.limit(0)).any()


# -- Line templates ---------------------------------------------------------------------------------------------------


def test_lines_recurring_in_many_contexts_are_dropped(spark, nothing):
    own = lambda k: f"document {'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'xyzuvw'[k // 26]} says something of its own here"
    notice = lambda k: f"Copyright 20{k:02d} by the people of example.org/{k}"
    general = ["red", "blue", "green", "black", "white", "brown", "grey", "pink", "gold", "cyan", "teal", "plum"]
    rows = [(k, "\n".join([own(k), notice(k), own(k + 50)])) for k in range(20)]
    rows += [(100 + k, "\n".join([own(k + 80), f"Please note the {c} license of this very long text", own(k + 110)])) for k, c in enumerate(general)]
    rows += [(200 + k, "first line of a copied text\nsecond line of a copied text\nthird line of it as well") for k in range(40)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "short line\n" + LONG)]
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, version string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["clean_text"]) for r in templates.drop_recurring_lines(df, carry=True).collect()}
    for k in range(20):
        assert got[k] == (3, 1, f"{own(k)}\n{own(k + 50)}")
    for k in range(len(general)):
        assert got[100 + k][1] == 1 and "license" not in got[100 + k][2]
    assert all(got[200 + k][1] == 0 for k in range(40))
    assert (got[300], got[301], got[302]) == ((0, 0, ""), (0, 0, ""), (3, 0, "\n\n")) and got[303][1] == 0
    assert templates.drop_recurring_lines(nothing).count() == 0


def test_line_templates_use_no_python(spark, small):
    plan = templates.drop_recurring_lines(small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def bytes_shuffled(df):
    """What the exchanges of the plan move, on tables too large to broadcast."""
    spark, held = df.sparkSession, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df = df.select("*")
        df.collect()
        plans, moved = [df._jdf.queryExecution().executedPlan()], 0
        while plans:
            plan = plans.pop()
            plans += [plan.children().apply(k) for k in range(plan.children().size())]
            if plan.nodeName() == "Exchange":
                moved += plan.metrics().apply("dataSize").value()
        return moved
    finally:
        for k in held:
            spark.conf.unset(k)


def test_texts_without_recurring_lines_are_not_shuffled(spark):
    rng = np.random.default_rng(4)
    notice = "all rights of this page are reserved by nobody"
    rows = [(k, "\n".join(" ".join(prose(rng, 8)) for _ in range(30)) + ("\n" + notice if k % 20 == 0 else "")) for k in range(400)]
    left = templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_dropped"] for r in left.collect()} == {k: int(k % 20 == 0) for k in range(400)}
    assert bytes_shuffled(left) < 0.3 * sum(len(t) for _, t in rows)


def prose(rng, n):
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]


def left_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r for r in templates.drop_recurring_lines(df).collect()}


def test_lines_of_near_copies_stay(spark):
    rng = np.random.default_rng(5)
    lines, rows = [prose(rng, 9) for _ in range(30)], []
    for k in range(1000):
        copy = [list(line) for line in lines]
        for at in rng.integers(0, 30, 6):  # every copy with words of its own, so that each line has many pairs of neighbours
            copy[at][int(rng.integers(0, 9))] = prose(rng, 1)[0]
        rows.append((k, "\n".join(" ".join(line) for line in copy)))
    rows += [(2000 + k, "\n".join([" ".join(prose(rng, 40)), "a line that many pages of this world share", " ".join(prose(rng, 40))])) for k in range(12)]
    got = left_of(spark, rows)
    assert all(got[k]["n_dropped"] == 0 and got[k]["clean_text"] == t for k, t in rows[:1000])
    assert all(got[2000 + k]["n_dropped"] == 1 for k in range(12))


def test_lines_that_dissimilar_texts_share_go(spark):
    rng = np.random.default_rng(6)
    around = lambda *shared: "\n".join([" ".join(prose(rng, 60)), *shared, " ".join(prose(rng, 60))])
    notice = [f"part {c} of a notice with five lines" for c in ("one", "two", "three", "four", "five")]
    passage = " ".join(prose(rng, 60))
    beside = "This page was made by the people of a town"
    copied = around(beside)
    rows = [(k, around(*notice)) for k in range(15)] + [(100 + k, around(passage)) for k in range(4)]
    rows += [(200 + k, around(beside)) for k in range(20)] + [(1000 + k, copied) for k in range(300)]
    rows += [(300 + k, around("only nine of these texts share this line")) for k in range(9)]
    got = left_of(spark, rows)
    assert all(got[k]["n_dropped"] == 5 and "notice" not in got[k]["clean_text"] for k in range(15))
    assert all(got[100 + k]["n_dropped"] == 1 for k in range(4))
    assert all(got[k]["n_dropped"] == 1 and beside not in got[k]["clean_text"] for k in [*range(200, 220), *range(1000, 1300)])
    assert all(got[300 + k]["n_dropped"] == 0 for k in range(9))


def hashes_of(spark, rows):
    """Spark's hash of each row of strings; nulls add nothing to it."""
    rows = sorted(set(rows), key=repr)
    columns = [f"c{k}" for k in range(len(rows[0]))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, " + ", ".join(f"{c} string" for c in columns))
    return {rows[r["k"]]: r["h"] for r in df.select("k", F.xxhash64(*columns).alias("h")).collect()}


def plain_shingles(words):
    at = lambda k: None if not 0 <= k < len(words) or words[k] == "\n" else "<*>" if re.search("[0-9@/]", words[k]) else words[k]
    return {(at(i), at(i + 1), at(i + 2)) for i in range(len(words)) if at(i) is not None and ((at(i + 1) is not None and at(i + 2) is not None) or at(i - 1) is None)}


def plain_recurring(spark, rows):
    """(lines, lines of recurring templates, what is left) of each id: templates, their leaves and the weights of their texts by loops over dictionaries."""
    parsed = {}
    for t in {t for _, t in rows}:
        tokens = [["<*>" if re.search("[0-9@/]", w) else w for w in plain_words(line)] for line in t.split("\n")]
        parsed[t] = [" ".join(w) if len(w) >= 4 else None for w in tokens]
    lines = {x for held in parsed.values() for x in held if x}
    words = {t: [w for w in re.sub("[\t\r]", " ", t.replace("\n", " \n ")).split(" ") if w] for t in parsed} | {x: x.split(" ") for x in lines}
    shingles = {x: plain_shingles(w) for x, w in words.items()}
    hashed = hashes_of(spark, [s for x in shingles.values() for s in x])
    sketch = {x: sorted({hashed[s] for s in found})[:16] for x, found in shingles.items()}
    of_line = {x[0]: h for x, h in hashes_of(spark, [(x,) for x in lines]).items()}
    leaf = lambda x: (len(x.split(" ")), *x.split(" ")[:3])
    least = lambda n: 3 if n > 50 else 10
    holders = {x: {t for t, held in parsed.items() if x in held} for x in lines}

    def many(by_text, n):  # the template that each text holds
        rest = {t: [h for h in sketch[t] if h not in sketch[x]] or [0] for t, x in by_text.items()}
        shared, count = Counter(h for r in rest.values() for h in r), len(rest)
        for r in rest.values():
            crowd = sorted((shared[h] for h in r if shared[h] > 1), reverse=True)
            if len(crowd) * 2 > len(r):
                count -= 1 - 1 / crowd[len(r) // 2]
        return round(count, 6) >= least(n)

    gone = {x for x in lines if len(holders[x]) >= least(leaf(x)[0]) and many(dict.fromkeys(holders[x], x), leaf(x)[0])}
    for key in {leaf(x) for x in lines}:
        own = [x for x in lines if leaf(x) == key]
        if len(own) < 2 or sum(len(holders[x]) for x in own) < least(key[0]):
            continue
        fixed = {}
        for at in range(3, key[0]):
            votes = Counter()
            for x in own:
                votes[x.split(" ")[at]] += len(holders[x])
            n, token = max((n, token) for token, n in votes.items())
            if n * 2 >= sum(votes.values()):
                fixed[at] = token
        fits = [x for x in own if all(x.split(" ")[at] == token for at, token in fixed.items())]
        by_text = {}
        for x in sorted(fits, key=of_line.get, reverse=True):
            by_text.update(dict.fromkeys(holders[x], x))
        if fixed and (len(fixed) + 3) * 100 >= key[0] * 70 and len(by_text) >= least(key[0]) and many(by_text, key[0]):
            gone.update(fits)

    def left(t):
        kept = [line for line, x in zip(t.split("\n"), parsed[t], strict=True) if x not in gone]
        return len(parsed[t]) if t else 0, len(parsed[t]) - len(kept), "\n".join(kept)

    return Counter((i, *left(t)) for i, t in rows)


def test_whole_line_templates_equal_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(8)
    line = lambda n=9: " ".join(prose(rng, n))
    family, rows = [prose(rng, 9) for _ in range(12)], []
    for k in range(40):  # near copies, each with words of its own
        copy = [list(x) for x in family]
        for at in rng.integers(0, 12, 3):
            copy[at][int(rng.integers(0, 9))] = prose(rng, 1)[0]
        rows.append((k, "\n".join(" ".join(x) for x in copy)))
    notice, passage = [f"part {c} of a notice of three lines" for c in ("one", "two", "three")], line(60)
    for k in range(16):
        rows.append((100 + k, "\n".join([line(30), *notice, line(30)])))
        rows.append((200 + k, "\n".join([line(20), f"Please note the {prose(rng, 1)[0]} licence of this page {k}/7", line(), f"made at 1{k}:00  by\tthe people of it", "short one"])))
        rows.append((300 + k, f"{line()}\nline that {7 + k % 5} of these texts have {'x' * (k % 3)}\n\n{line(4)}"))
    rows += [(400 + k, f"{line(30)}\n{passage}\n{line(30)}") for k in range(4)] + [(500, rows[41][1])] * 30
    rows += [(600, ""), (601, "\n\n"), (602, "one two"), (None, rows[44][1])]
    spark.createDataFrame([*rows, (603, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in QUERIES["line_template_texts"](spark, str(tmp_path)).collect())
    want = plain_recurring(spark, [*rows, (603, "")])
    assert got == want and sum(r[2] for r in want) > 80
    # Lines of near copies stay and inner lines of a notice go, which neighbouring lines alone cannot tell.
    dropped = {r[0]: r[2] for r in got}
    assert all(dropped[k] == 0 for k in range(40)) and all(dropped[100 + k] == 3 for k in range(16))


# -- Classifiers ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name, target, least", [("op3_ftrl_toxicity", "toxic", 0.95), ("op7_subword_quality", "quality", 0.95)])
def test_classifiers_on_rows_they_never_saw(spark, name, target, least):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[target] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in unseen) >= least * len(unseen)
    rare = 1 if target == "toxic" else 0
    assert sum(p == rare for p, y in unseen if y == rare) >= 0.8 * sum(y == rare for _, y in unseen)


def test_classifiers_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, None, 1), (None, 1, 1), (4, 0, 0), (77, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for found in (toxicity.toxicity(awkward, toxicity.train(awkward, labels)), quality_model.quality(awkward, quality_model.train(awkward, labels))):
        rows = found.collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    none = labels.limit(0)
    assert toxicity.toxicity(nothing, toxicity.train(awkward, none)).count() == 0
    assert {r["score"] for r in quality_model.quality(awkward, quality_model.train(nothing, none)).collect()} == {0.5}


def test_labels_of_held_out_rows_change_nothing(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    assert toxicity.train(small, labels) == toxicity.train(small, turned)


# -- Pages ------------------------------------------------------------------------------------------------------------


def page_of(spark, rows):
    df = spark.createDataFrame([(i, u, h, "t") for i, u, h in rows], "page_id long, url string, html string, text string")
    return {r["page_id"]: r for r in pages.extract(df).collect()}


def test_pages_lose_what_their_site_repeats(spark):
    words = [f"word{k} of page" for k in range(12)]
    rows = [(k, f"https://u@One.example:80/{k}", f"<body><div class=box><p>Our  site &amp; you</p><b>Go</b></div><div><p>{w}</p><p>more {w}</p></div></body>") for k, w in enumerate(words)]
    rows += [(50, "https://two.example/", "<body><div class=box><p>Our site &amp; you</p><b>Go</b></div><p>single</p></body>")]
    got = page_of(spark, rows)
    assert all(got[k]["text"] == f"{w}\nmore {w}" and got[k]["n_deleted"] >= 1 for k, w in enumerate(words))
    assert got[50]["text"] == "Our site & you Go\nsingle".replace(" Go", "\nGo")


def test_blocks_on_few_pages_of_a_large_site_go(spark):
    block = "<div><b>Offers</b> of the <i>week</i></div>"
    rows = [(k, f"https://large.example/{k}", f"<body><div>text {k}</div>{block if k % 100 == 0 else ''}{'<div>thrice</div>' if k < 3 else ''}</body>") for k in range(5000)]
    got = page_of(spark, rows)
    assert all(got[k]["text"] == f"text {k}" + ("\nthrice" if k < 3 else "") and got[k]["n_deleted"] == (k % 100 == 0) for k in range(5000))


def test_pages_keep_the_article_alone(spark):
    source = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use</div><!-- <p>hidden</p> -->
    <main><article><header><h1>Title &eacute;</h1></header><p>One <b>bold</b>
      text&nbsp;here<br>next<p>Two &lt;x&gt; <a title="a>b">link</a></p><div class=advert>Buy</div><form><input value=1>Send</form>
    <ul><li>a<li>b</ul><table><tr><td>1<td>2</table><aside>Side</aside><section id="comments"><article><p>reader</p></article></section></article></main>
    <div class="sidebar">S</div><footer>&copy; me</footer><p>after</body></html>"""
    got = page_of(spark, [(1, "http://x.example/1", source), (2, None, None), (3, "x", ""), (4, "http://y.example", "just < text & more"), (5, "http://y.example", "<p>un<b>closed <i>tags"), (6, "http://z", "<div>" * 3000 + "deep")])
    assert got[1]["text"] == "Title é\nOne bold text here next\nTwo <x> link\na\nb\n1\n2"
    assert [got[k]["text"] for k in (2, 3, 4, 5, 6)] == ["", "", "just < text & more", "unclosed tags", "deep"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert page_of(spark, [])== {}


# -- Chats ------------------------------------------------------------------------------------------------------------


def test_chats_link_order_check_and_serialise(spark):
    tool = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 1}, "who": {"enum": ["a", "$c9"]}, "of": {"type": "array", "items": {"type": "string", "maxLength": 3}}}}
    call = lambda i, args, name="f": [(i, name, args)]
    rows = [
        (1, 0, "user", "hi é", None, None), (1, 1, "assistant", None, call("c1", '{"n": 1, "of": ["$c9"]}'), None), (1, 2, "tool", "r1", None, "c1"),
        (1, 3, "assistant", "text too", call("c9", '{"n":0,"z":1}'), None), (1, 3, "tool", "r9", None, "c9"), (1, 4, "assistant", None, call("c1", "{}"), None),
        (1, 5, "tool", None, None, "zz"), (1, 6, "assistant", "", call(None, "nonsense", "g"), None), (2, 0, "tool", "early", None, "c1"),
        (2, 1, "assistant", None, [("c1", "f", '{"n":2}'), ("c2", "f", '{"n":NaN}')], None),
        (3, 0, "assistant", None, [("a", "f", '{"n":1,"who":"$b"}'), ("b", "f", '{"n":1,"who":"$a"}')], None), (None, None, None, None, None, None)]
    messages = spark.createDataFrame([(*r, "x") for r in rows], chat.MESSAGES + ", status string")
    tools = spark.createDataFrame([("f", json.dumps(tool))], "name string, schema string")
    got = {(r["conv_id"], r["turn"], r["kind"], r["part"]): r for r in chat.format_chats(messages, tools).collect()}
    status = {k: r["status"] for k, r in got.items()}
    assert status == {
        (1, 0, "message", -1): "plain", (1, 1, "call", 0): "linked", (1, 2, "result", -1): "linked", (1, 3, "message", -1): "plain", (1, 3, "call", 0): "linked", (1, 3, "result", -1): "linked",
        (1, 4, "call", 0): "duplicate", (1, 5, "result", -1): "orphan", (1, 6, "call", 0): "unanswered", (2, 0, "result", -1): "linked", (2, 1, "call", 0): "linked", (2, 1, "call", 1): "unanswered",
        (3, 0, "call", 0): "unanswered", (3, 0, "call", 1): "unanswered", (None, None, "message", -1): "plain"}
    order = lambda k: (got[k]["at"], got[k]["step"])
    assert order((2, 1, "call", 0)) < order((2, 0, "result", -1))
    assert order((1, 3, "call", 0)) < order((1, 3, "result", -1)) < order((1, 1, "call", 0)) < order((1, 2, "result", -1))
    assert {k for k, r in got.items() if r["cyclic"]} == {(3, 0, "call", 0), (3, 0, "call", 1)}
    assert got[1, 1, "call", 0]["errors"] == [] and got[1, 1, "call", 0]["valid"]
    assert got[1, 3, "call", 0]["errors"] == ["$.z: unknown", "$.n: below minimum"]
    assert got[1, 6, "call", 0]["errors"] == ["$: not JSON", "$: unknown tool"] and got[2, 1, "call", 1]["valid"] is False
    assert got[1, 0, "message", -1]["json"] == '{"content":"hi é","role":"user"}'
    assert got[1, 1, "call", 0]["json"] == '{"role":"assistant","tool_call":{"arguments":{"n":1,"of":["$c9"]},"id":"c1","name":"f"}}'
    assert chat.format_chats(messages.limit(0), tools).count() == 0


def test_chats_with_odd_arguments(spark):
    deep = {name: "[" * n + "]" * n for name, n in (("c1", 100_000), ("c2", 3_000))}
    given = [("c0", "f", '{"a":"\\ud800x"}'), ("c1", "f", deep["c1"]), ("c2", "f", deep["c2"]), ("c3", "broken", "{}"), ("c4", "f", '{"\\udfff":1}'), ("c5", "f", "{}")]
    rows = [(1, k, "assistant", None, [call], None) for k, call in enumerate(given)]
    tools = spark.createDataFrame([("f", '{"type":"object","properties":{"a":{"type":"string"}},"additionalProperties":false}'), ("broken", "{")], "name string, schema string")
    got = {r["call_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, chat.MESSAGES), tools).collect()}
    assert {i: r["valid"] for i, r in got.items()} == {"c0": True, "c1": False, "c2": False, "c3": False, "c4": False, "c5": True}
    assert got["c3"]["errors"] == ["$: schema is not JSON"] and got["c1"]["errors"] == ["$: nested too deep"]
    for i, arguments in deep.items():
        assert json.loads(got[i]["json"])["tool_call"]["arguments"] == arguments
    assert json.loads(got["c0"]["json"])["tool_call"]["arguments"] == {"a": "\ud800x"}


def test_repeats_query_shows_what_is_left(spark, small):
    rows = QUERIES["op10_interval_tree_repeats"](spark, SMALL).collect()
    digests = {r["doc_id"]: tuple(r) for r in repeats.remove_repeats(small, digest=True).collect()}
    whole = dict(texts(small))
    assert {r["doc_id"]: tuple(r)[:5] for r in rows} == digests
    for r in rows:
        assert r["repeats"] == (r["n_removed"] > 0)
        if not r["repeats"]:
            assert r["kept_text"] == whole[r["doc_id"]]
        elif "\ufffd" not in r["kept_text"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_chat_chains_of_late_needs(spark):
    calls = [(1, 0, "assistant", None, [(f"c{k}", "f", json.dumps({"x": f"$c{k + 1}"}) if k < 11 else "{}") for k in range(12)], None)]
    answers = [(1, k + 1, "tool", "r", None, f"c{k}") for k in range(12)]
    messages = spark.createDataFrame(calls + answers, chat.MESSAGES)
    got = chat.format_chats(messages, spark.createDataFrame([("f", "{}")], "name string, schema string")).collect()
    place = {(r["kind"], r["call_id"]): (r["at"], r["step"]) for r in got}
    assert not any(r["cyclic"] for r in got)
    for k in range(12):
        assert place["call", f"c{k}"] < place["result", f"c{k}"]
        if k < 11:
            assert place["result", f"c{k + 1}"] < place["call", f"c{k}"]
