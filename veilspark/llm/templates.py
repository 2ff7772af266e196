"""Line dedup with a tree of line templates, in DataFrame functions alone.

A line is parsed down a tree of fixed depth: first by its number of tokens, then by its
first ``DEPTH`` tokens, to a leaf. Tokens with a digit, ``@`` or ``/`` are variable fields
from the start (``<*>``). Two kinds of templates hang from a leaf: each distinct line with
its variable fields, and one generalised template, whose remaining positions hold the token
that most of the leaf's lines have there, or ``<*>`` where no token has half of them. The
latter counts if at least ``SIMILARITY`` percent of its positions are fixed.

A template recurs if its lines stand in at least ``MIN_TEXTS`` texts that have little in
common, or in ``MIN_TEXTS_LONG`` of them if the line has more than ``LONG_LINE`` tokens. Equal
texts count once. Each text has a sketch, the ``SKETCH`` smallest hashes of its
three-word shingles. A text of which more than half the sketch, without what the line
itself puts there, is in the sketches of other texts with the line counts as a fraction: one
by the number of texts that hold that much. So a family of near copies counts about once,
however large it is, and does not make its own lines recurring; a notice of any length in
many documents does. Lines of recurring templates are dropped.

``by="places"`` is the rule of op9's expected SQL: a template recurs if its lines stand in at
least ``MIN_CONTEXTS`` different contexts (the line before and the line after), and these are
at least a ``SPREAD``-th of all its lines. It drops lines of near copies that differ around
them, and keeps inner lines of longer notices and lines that a much copied text holds.

Lines are counted by partial aggregates; no step gathers the lines of a template, a leaf or
a source. What is gathered is a leaf's template, at most the tokens of one line, and the
counts of one sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import rows_of, split_by, store

DEPTH, MIN_TOKENS, MIN_CONTEXTS, SPREAD, SIMILARITY = 3, 4, 10, 4, 70
MIN_TEXTS, MIN_TEXTS_LONG, LONG_LINE, SKETCH = 10, 3, 50, 16

#: Most leaves, templates and shared hashes that are broadcast (8 bytes each, a template with its sketch 140); more are joined by a shuffle.
MAX_BROADCAST = 200_000
_SPACE = r"\x20\x09-\x0D"
_UNEVEN = r"[0-9@/\x09-\x0D]|  "  # what a line of plain words with single spaces does not have
_VARIABLE = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@/]*+[0-9@/][^{_SPACE}]*+"  # tried where a token begins, not at each of its characters


def parse(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line of ``MIN_TOKENS`` tokens or more: whose it is, its leaf, template and context."""
    lines = rows_of(docs, id_col, text_col).select("id", F.xxhash64("text").alias("version"), F.split("text", "\n", -1).alias("lines"))
    lines = lines.select("id", "version", F.posexplode_outer("lines").alias("pos", "line"), "lines")
    context = F.xxhash64(F.coalesce(F.get("lines", F.col("pos") - 1), F.lit("")), F.coalesce(F.get("lines", F.col("pos") + 1), F.lit("")))
    plain = F.when(F.col("line").rlike(_UNEVEN), F.regexp_replace(F.regexp_replace("line", _VARIABLE, "<*>"), rf"[{_SPACE}]+", " ")).otherwise(F.col("line"))
    # An array of one, exploded: the filter below would else run the expressions of the line again.
    rows = lines.select("id", "version", "pos", "lines", F.explode_outer(F.array(F.btrim(plain, F.lit(" ")))).alias("line"))
    size = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    rows = rows.where((F.col("line") != "") & (size >= MIN_TOKENS)).select("id", "version", "pos", context.alias("context"), "line")
    leaf = F.xxhash64(size, F.substring_index("line", " ", DEPTH))
    return rows.select("id", "version", "pos", "context", (size > LONG_LINE).alias("long"), leaf.alias("leaf"), F.xxhash64("line").alias("template"), "line")


def sketch(words: Column) -> Column:
    """The smallest hashes of the shingles of an array of words, in which a line feed is a word.

    Variable fields are one word. No shingle crosses a line; a shorter line begins one all the same.
    """
    fields = F.transform(words, lambda w: F.when(w == "\n", None).when(w.rlike("[0-9@/]"), F.lit("<*>")).otherwise(w))

    def hashes(ws: Column) -> Column:
        at = lambda i, k: F.get(ws, i + k)
        whole = lambda i: at(i, 0).isNotNull() & ((at(i, 1).isNotNull() & at(i, 2).isNotNull()) | at(i, -1).isNull())
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ws) - 1)), whole), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))

    return F.get(F.transform(F.transform(F.array(fields), hashes), lambda h: F.slice(F.array_sort(F.array_distinct(h)), 1, SKETCH)), F.lit(0))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(version, sketch) of every text."""
    spaced = F.translate(F.replace(F.col("text"), F.lit("\n"), F.lit(" \n ")), "\t\r", "  ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    return rows_of(docs, id_col, text_col).select(F.xxhash64("text").alias("version"), sketch(words).alias("sketch")).dropDuplicates(["version"])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def dissimilar(holders: DataFrame, own: DataFrame, sketched: DataFrame) -> DataFrame:
    """(key, texts): how many texts with little in common hold a key. ``holders`` has distinct (key, version) and a template, ``own`` the templates' sketches."""
    rest = F.array_except("sketch", "own")
    rest = F.when(F.size(rest) > 0, rest).otherwise(F.array(F.lit(0).cast("long")))  # texts of this line alone are alike
    held = store(holders.join(_small(own), "template").join(sketched, "version").select("key", "version", rest.alias("rest")), "held")
    marks = held.select("key", "version", F.size("rest").alias("of"), F.explode("rest").alias("mark"))
    shared = store(marks.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    crowd = marks.join(_small(shared), ["key", "mark"]).groupBy("key", "version").agg(F.first("of").alias("of"), F.sort_array(F.collect_list("n"), False).alias("n"))
    crowd = crowd.where(F.size("n") * 2 > F.col("of")).select("key", F.get("n", F.expr("of div 2").cast("int")).alias("n"))
    less = crowd.groupBy("key").agg(F.sum(1 - 1 / F.col("n")).alias("less"))
    texts = F.round(F.col("texts") - F.coalesce("less", F.lit(0.0)), 6)
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).join(less, "key", "left").select("key", texts.alias("texts"))


def fitting(lines: DataFrame, counts: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, template) of the lines that fit their leaf's generalised template; ``counts`` has what each template weighs."""
    members = store(
        lines.join(_small(leaves), "leaf", "left_semi").groupBy("leaf", "template").agg(F.first("line").alias("line"))
        .join(counts, ["leaf", "template"]).select("leaf", "template", F.split("line", " ").alias("tokens"), "weight"), "members")
    tokens = members.select("leaf", F.size("tokens").alias("size"), "weight", F.posexplode("tokens").alias("pos", "token")).where(F.col("pos") >= DEPTH)
    votes = tokens.groupBy("leaf", "size", "pos", "token").agg(F.sum("weight").alias("votes"))
    best = votes.groupBy("leaf", "size", "pos").agg(F.sum("votes").alias("all"), F.max(F.struct("votes", "token")).alias("best"))
    fixed = best.where(F.col("best.votes") * 2 >= F.col("all")).groupBy("leaf", "size").agg(F.collect_list(F.struct("pos", F.col("best.token").alias("token"))).alias("fixed"))
    fixed = fixed.where((F.size("fixed") + DEPTH) * 100 >= F.col("size") * SIMILARITY)
    fits = members.join(fixed, "leaf").where(F.forall("fixed", lambda f: F.get(F.col("tokens"), f["pos"]) == f["token"])).select("leaf", "template")
    return store(fits, "fits")


def recurring(lines: DataFrame, sketched: DataFrame) -> DataFrame:
    """The templates, by hash of the line with its variable fields, whose lines dissimilar texts share."""
    least = F.when(F.col("long"), MIN_TEXTS_LONG).otherwise(MIN_TEXTS)
    places = store(lines.select("leaf", "long", "template", "version").distinct(), "places")
    counts = places.groupBy("leaf", "long", "template").agg(F.count(F.lit(1)).alias("weight"))
    often = counts.where(F.col("weight") >= least).select(F.lit(True).alias("exact"), F.col("template").alias("of"), "long")

    # Leaves that may have a generalised template.
    leaves = counts.groupBy("leaf", "long").agg(F.count(F.lit(1)).alias("templates"), F.sum("weight").alias("weight"))
    leaves = store(leaves.where((F.col("templates") > 1) & (F.col("weight") >= least)).select("leaf"), "leaves")
    fits = fitting(lines, counts.drop("long"), leaves)
    spread = store(places.join(fits, ["leaf", "template"], "left_semi").groupBy("leaf", "long", "version").agg(F.min("template").alias("template")), "spread")
    general = spread.groupBy("leaf", "long").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)
    keys = store(often.union(general.select(F.lit(False), "leaf", "long")), "keys")

    # Of both kinds, those whose texts have little in common.
    key = lambda exact, of: F.struct(F.lit(exact).alias("exact"), F.col(of).alias("of")).alias("key")
    holders = places.join(_small(keys.where("exact").select(F.col("of").alias("template"))), "template", "left_semi").select(key(True, "template"), "template", "version")
    holders = store(holders.union(spread.join(_small(keys.where("NOT exact").select(F.col("of").alias("leaf"))), "leaf", "left_semi").select(key(False, "leaf"), "template", "version")), "holders")
    wanted = store(holders.select("template").distinct(), "wanted")
    own = lines.join(_small(wanted), "template", "left_semi").groupBy("template").agg(F.first("line").alias("line"))
    own = store(own.select("template", sketch(F.split("line", " ")).alias("own")), "own")
    found = dissimilar(holders, own, sketched).select("key.exact", "key.of", "texts").join(_small(keys), ["exact", "of"])
    found = store(found.where(F.col("texts") >= least).select("exact", "of"), "recurring")
    return found.where("exact").select(F.col("of").alias("template")).union(
        fits.join(found.where("NOT exact").select(F.col("of").alias("leaf")), "leaf", "left_semi").select("template")).distinct()


def recurring_places(lines: DataFrame) -> DataFrame:
    """The templates whose lines stand between many pairs of neighbours."""
    enough = (F.col("weight") >= MIN_CONTEXTS) & (F.col("weight") * SPREAD >= F.col("n"))
    places = store(lines.groupBy("leaf", "template", "context").agg(F.count(F.lit(1)).alias("n")), "places")
    counts = places.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("weight"), F.sum("n").alias("n"))
    exact = counts.where(enough).select("template")
    leaves = counts.groupBy("leaf").agg(F.count(F.lit(1)).alias("templates"), F.sum("weight").alias("weight"))
    leaves = store(leaves.where((F.col("templates") > 1) & (F.col("weight") >= MIN_CONTEXTS)).select("leaf"), "leaves")
    fits = fitting(lines, counts.drop("n"), leaves)
    spread = places.join(fits, ["leaf", "template"], "left_semi").groupBy("leaf", "context").agg(F.sum("n").alias("n"))
    general = spread.groupBy("leaf").agg(F.count(F.lit(1)).alias("weight"), F.sum("n").alias("n")).where(enough)
    return exact.union(fits.join(general, "leaf", "left_semi").select("template")).distinct()


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, by: str = "texts") -> DataFrame:
    """One row per document: id, ``n_lines``, ``n_dropped`` and ``clean_text`` without lines of recurring templates.

    Kept lines stay in order, joined by ``\\n``. Null and empty texts have no lines and an
    empty clean text. Repeated rows give repeated results and count as copies. A document
    made of recurring lines alone is left with an empty text. ``carry`` adds the table's
    other columns as ``row``. ``by`` is what is counted: dissimilar "texts" or "places".
    """
    if by not in ("texts", "places"):
        raise ValueError(f"by must be texts or places, not {by}")
    lines = store(parse(docs, id_col, text_col).drop(*(["context"] if by == "texts" else ["long"])), "lines")
    gone = recurring(lines, store(sketches(docs, id_col, text_col), "sketches")) if by == "texts" else recurring_places(lines)
    dropped = store(lines.join(gone, "template", "left_semi").groupBy("id", "version").agg(F.collect_set("pos").alias("dropped")), "dropped")
    rows = rows_of(docs, id_col, text_col, carry).withColumn("version", F.xxhash64("text"))
    some, whole = split_by(rows, F.col("version"), F.col("version"), dropped)
    joined = some.alias("d").join(dropped.alias("x"), F.col("d.id").eqNullSafe(F.col("x.id")) & (F.col("d.version") == F.col("x.version")), "left")
    joined = joined.select("d.*", "x.dropped").unionByName(whole, allowMissingColumns=True)
    keep = F.expr("""CASE WHEN dropped IS NULL THEN text ELSE
        transform(array(split(text, '\\n', -1)), ls -> array_join(transform(
            array_except(sequence(0, size(ls) - 1), dropped), i -> get(ls, i)), '\\n'))[0] END""")
    n_lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    return joined.select(
        F.col("id").alias(id_col), n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), keep.alias("clean_text"), *([F.col("row")] if carry else []))
