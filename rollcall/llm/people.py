"""Problem 3: variant spellings of names of people and organisations.

1. Names become folded tokens, organisations a core and a type (one Arrow pass; names.py).
2. A spelling of an organisation's core belongs to the most frequent core of the tenant within two letters, and so on to
   the end of the chain. Cores within two letters have one of three pieces in common, so pieces are the keys of that join.
3. Rows of one tenant, employer and token set are one vertex. Candidate pairs of vertices come from a prefix-filtered
   set-similarity join on token q-grams (order-free 2-grams of tokens, the second reduced to its initial) within the
   employer, and from a shared e-mail address or phone number.
4. Candidates are verified by soft token likeness weighted by the tokens' rarity in the corpus: the same tokens but for
   errors and short forms link at the same employer or with a shared contact; abbreviations link with a shared contact,
   or to the one person of the employer they can stand for.
5. Linked vertices get one class by min-label propagation with pointer jumping; rounds are checkpointed.

A contact is an office's, and no evidence, if more than OFFICE people use it. People are counted, not spellings: a name
that is alike to a fuller one of the same contact is that person's.

Scale: vertices, not rows, are joined, so copies never meet each other. The prefix filter probes the rarest q-grams of the
smaller set. A q-gram of more than HOT vertices (of a hot employer, or of a switchboard) is no meeting place by itself:
names that share it are alike only if another token is too, so its vertices meet by the variants of their other tokens,
which finds the same links. Nothing is collected, and only tables under a checked size are broadcast. Weights cover all rows.

Defined results: rows without a name are linked by organisation only; rows with neither have no class; null and blank
are alike; e-mail addresses in a name field are no name; texts of any length are read whole; repeated rows share their
class; ties between cores go to the alphabetically first; cores of fewer than four letters are acronyms and have no
variants, those of four have variants of one letter; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from rollcall.llm import names
from rollcall.llm.skeleton import look_alike_table, use
from rollcall.session import BROADCAST_BYTES, broadcast_if_small, cut, size_estimate

#: A contact used by more people than this is an office's.
OFFICE = 3
#: Vertices that meet by a shared key alone; those of larger keys meet by their other tokens as well.
HOT = 64
#: Share of the smaller set of q-grams two names of an employer have in common at least.
OVERLAP = 1 / 3
LEAST_STRONG, LEAST_WEAK, LEAST_CONTACT = 0.7, 0.45, 0.35
ROUNDS = 30
#: Pairs of a group that one task decides; larger groups are decided in rounds over the cluster.
GROUP = 10_000
# What links two names for sure, and what only does if the shorter one fits one class.
SURE = f"(class = {names.STRONG} and score >= {LEAST_STRONG}) or (class = {names.WEAK} and contact and score >= {LEAST_CONTACT})"
MAYBE = f"class = {names.WEAK} and not contact and same_employer and score >= {LEAST_WEAK}"
_FINER = ArrayType(StructType().add("gram", StringType()).add("part", StringType()).add("role", IntegerType()))


def _parsed(spark: SparkSession) -> Callable:
    table = look_alike_table(spark)

    @F.pandas_udf(StructType().add("text", StringType()).add("core", StringType()).add("kind", StringType()))
    def parsed(name: pd.Series, organization: pd.Series) -> pd.DataFrame:
        use(table.value)
        people = [" ".join(names.name_tokens(n)) for n in name]
        offices = [names.organisation(o) for o in organization]
        return pd.DataFrame({"text": people, "core": [c for c, _ in offices], "kind": [k for _, k in offices]})

    return parsed


@functools.lru_cache(1 << 16)
def _split(text: str) -> tuple[str, ...]:
    return tuple(text.split(" "))


@F.pandas_udf(ArrayType(StringType()))
def _name_grams(text: pd.Series) -> pd.Series:
    return text.map(lambda t: names.name_grams(_split(t)))


@F.pandas_udf(ArrayType(StringType()))
def _contact_grams(text: pd.Series) -> pd.Series:
    return text.map(lambda t: names.contact_grams(_split(t)))


@F.pandas_udf(_FINER)
def _finer_name_grams(text: pd.Series) -> pd.Series:
    return text.map(lambda t: names.finer_name_grams(_split(t)))


@F.pandas_udf(_FINER)
def _finer_contact_grams(text: pd.Series) -> pd.Series:
    return text.map(lambda t: names.finer_contact_grams(_split(t)))


@functools.lru_cache(1 << 16)
def _quarters(text: str) -> tuple[float, ...]:
    """Weights written as one character each, in quarters from '!'."""
    return tuple((ord(c) - 33) / 4 for c in text)


@F.pandas_udf(StructType().add("class", IntegerType()).add("score", DoubleType()))
def _compared(a: pd.Series, b: pd.Series, wa: pd.Series, wb: pd.Series, contact: pd.Series) -> pd.DataFrame:
    """Likeness of names; without a shared contact only of those that have enough q-grams in common."""
    none = (names.NONE, 0.0)
    got = [names.compare_names(_split(x), _split(y), _quarters(p), _quarters(q)) if c or names.overlap(_split(x), _split(y), OVERLAP) else none for x, y, p, q, c in zip(a, b, wa, wb, contact)]
    return pd.DataFrame({"class": [c for c, _ in got], "score": [s for _, s in got]}).astype({"class": "int32"})


def email_key(c: Column | str) -> Column:
    """Host and mailbox of a personal address however it is written; null if there is none."""
    v = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    v = F.when(v.contains("＠") | v.contains("．"), F.translate(v, "＠．", "@.")).otherwise(v)
    v = F.when(v.contains("(at)") | v.contains("[at]") | v.contains(" at "), F.regexp_replace(v, "\\(at\\)|\\[at\\]| at ", "@")).otherwise(v)
    v = F.regexp_replace(F.regexp_replace(v, "mailto:|[<>\\s\\u00a0\"']", ""), "[;,.]+$", "")
    box = F.regexp_replace(F.regexp_extract(v, "^([^@]+)@", 1), "\\+.*$|[._-]", "")
    host = F.regexp_extract(v, "@([a-z0-9.-]+\\.[a-z]{2,})$", 1)
    return F.when((box != "") & (host != "") & (box != F.split(host, "\\.")[0]), F.concat(box, F.lit("@"), host))


def phone_key(c: Column | str) -> Column:
    """The nine digits after the trunk prefix or country code; null if the text doesn't state them."""
    v = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    v = F.when(F.octet_length(v) > F.length(v), F.translate(v, "０１２３４５６７８９", "0123456789")).otherwise(v)
    v = F.regexp_replace(v, "\\.0$", "")
    digits = F.regexp_extract(F.regexp_replace(v, "[^0-9]", ""), "^(?:00?84|84|0)?([1-9][0-9]{8})$", 1)
    return F.when((digits != "") & ~digits.rlike("^(\\d)\\1+$") & (digits != "123456789") & ~v.rlike("[?xX*]"), digits)


def parse_rows(rows: DataFrame) -> DataFrame:
    """(row_id, tenant, name_hash, organization_hash, text, core, kind, email_key, phone_key, host) of rows (row_id, tenant, full_name, organization, email, phone)."""
    p = _parsed(rows.sparkSession)("full_name", "organization")
    parsed = rows.select("row_id", "tenant", F.xxhash64("full_name").alias("name_hash"), F.xxhash64("organization").alias("organization_hash"), p.alias("p"), email_key("email").alias("email_key"), phone_key("phone").alias("phone_key"))
    return parsed.select("row_id", "tenant", "name_hash", "organization_hash", "p.text", "p.core", "p.kind", "email_key", "phone_key", host_of("email_key").alias("host"))


def host_of(email: str) -> Column:
    """The first word of an address's host without hyphens, '' if there is no address."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(email, F.lit("")), "@([a-z0-9-]+)\\.", 1), "-", "")


# Employers.


def core_kinds(parsed: DataFrame) -> DataFrame:
    """(tenant, core, kind, n): spellings of organisations' cores with the types told beside them, and their rows."""
    return parsed.filter("core <> ''").groupBy("tenant", "core", "kind").agg(F.count(F.lit(1)).alias("n"))


def _pieces(parts: int) -> Column:
    """(at, piece) of a core cut into parts of even size; at is the part's number."""
    cuts = [F.floor(F.length("core") * k / parts).cast("int") for k in range(parts + 1)]
    return F.array(*(F.struct(F.lit(k).alias("at"), F.substring(F.col("core"), cuts[k] + 1, cuts[k + 1] - cuts[k]).alias("piece")) for k in range(parts)))


def core_pieces(cores: DataFrame) -> DataFrame:
    """(key, tenant, core): the pieces cores are found by. Within two letters one of three pieces is whole, within one letter one of two."""
    three = cores.filter(F.length("core") >= 5).select("tenant", "core", F.lit(3).alias("parts"), F.explode(_pieces(3)).alias("p"))
    two = cores.filter(F.length("core").isin(4, 5)).select("tenant", "core", F.lit(2).alias("parts"), F.explode(_pieces(2)).alias("p"))
    every = three.unionByName(two)
    return every.select(F.xxhash64("tenant", "parts", F.length("core"), "p.at", "p.piece").alias("key"), "tenant", "core")


def _probes(cores: DataFrame, parts: int, reach: int, least: int) -> DataFrame:
    """(key, tenant, core): every piece a core within `reach` letters may have left whole in this one; few come twice, and pairs are made distinct later."""
    lengths = F.filter(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.length("core") + d), lambda n: n >= least)
    one = cores.select("tenant", "core", F.explode(lengths).alias("of"))
    at = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("at")
    one = one.select("tenant", "core", "of", at)
    start, end = (F.floor(F.col("of") * (F.col("at") + k) / parts).cast("int") for k in (0, 1))
    moved = one.select("tenant", "core", "of", "at", start.alias("start"), (end - start).alias("size"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("by"))
    inside = moved.filter((F.col("start") + F.col("by") >= 0) & (F.col("start") + F.col("by") + F.col("size") <= F.length("core")))
    piece = F.substring(F.col("core"), F.col("start") + F.col("by") + 1, F.col("size"))
    return inside.select(F.xxhash64("tenant", F.lit(parts), "of", "at", piece).alias("key"), "tenant", "core")


def near_cores(fresh: DataFrame, pieces: DataFrame) -> DataFrame:
    """(tenant, core, other): pairs of cores within two letters (one if one has only four), one of `fresh`, the other among those of `pieces`."""
    probes = _probes(fresh.filter(F.length("core") >= 5), 3, 2, 5).unionByName(_probes(fresh.filter(F.length("core").isin(4, 5)), 2, 1, 4))
    pairs = probes.join(pieces.select("key", F.col("core").alias("other")), "key").filter("core <> other").select("tenant", "core", "other").distinct()
    short = F.least(F.length("core"), F.length("other")) < 5
    return pairs.filter(F.when(short, F.levenshtein("core", "other", 1)).otherwise(F.levenshtein("core", "other", 2)) >= 0)


def spelling_roots(counts: DataFrame, near: DataFrame) -> DataFrame:
    """(tenant, core, to_core): the core each spelling stands for, of spellings (tenant, core, n) and pairs near(tenant, core, other) both ways.

    Each goes to its most frequent neighbour if that is more frequent (or as frequent and before it in the alphabet), and
    on to the end. Only spellings that go somewhere take part in the rounds.
    """
    n = counts.select("tenant", F.col("core").alias("other"), F.col("n").alias("other_n"))
    better = (F.col("other_n") > F.col("n")) | ((F.col("other_n") == F.col("n")) & (F.col("other") < F.col("core")))
    best = near.join(counts, ["tenant", "core"]).join(n, ["tenant", "other"]).filter(better).groupBy("tenant", "core").agg(F.min_by("other", F.struct((-F.col("other_n")).alias("n"), "other")).alias("to_core"))
    return with_ends(counts.select("tenant", "core"), cut(best))


def with_ends(cores: DataFrame, best: DataFrame) -> DataFrame:
    """(tenant, core, to_core) of cores (tenant, core): the end of the chain that best (tenant, core, to_core) begins, or the core itself."""
    while True:
        onward = best.select("tenant", F.col("core").alias("to_core"), F.col("to_core").alias("last"))
        if best.join(onward, ["tenant", "to_core"], "left_semi").isEmpty():
            break
        best = cut(best.join(onward, ["tenant", "to_core"], "left").select("tenant", "core", F.coalesce("last", "to_core").alias("to_core")))
    return cores.join(broadcast_if_small(best), ["tenant", "core"], "left").withColumn("to_core", F.coalesce("to_core", "core"))


def usual_kinds(kinds: DataFrame, spelt: DataFrame) -> DataFrame:
    """(tenant, to_core, usual): the type most rows of a core tell, of core_kinds() and spelling_roots()."""
    told = kinds.filter("kind <> ''").join(spelt, ["tenant", "core"]).groupBy("tenant", "to_core", "kind").agg(F.sum("n").alias("n"))
    return told.groupBy("tenant", "to_core").agg(F.max_by("kind", F.struct("n", "kind")).alias("usual"))


def with_employers(parsed: DataFrame, spelt: DataFrame, usual: DataFrame) -> DataFrame:
    """parsed with `employer`: core and type; the host of the address where no organisation is given; null if neither names one of the tenant's."""
    known = broadcast_if_small(spelt.select("tenant", F.col("core").alias("_core"), "to_core"))
    placed = parsed.withColumn("_core", F.when(F.col("core") != "", F.col("core")).when(F.col("host") != "", F.col("host"))).join(known, ["tenant", "_core"], "left").drop("_core")
    typed = placed.join(broadcast_if_small(usual), ["tenant", "to_core"], "left")
    kind = F.when(F.col("kind") != "", F.col("kind")).otherwise(F.coalesce("usual", F.lit("")))
    return typed.withColumn("employer", F.when(F.col("to_core").isNotNull(), F.concat("to_core", F.lit("/"), kind))).drop("to_core", "usual")


# Vertices.


def with_vertices(placed: DataFrame) -> DataFrame:
    """placed with `vertex`, the id of tenant, employer and name words, `place`, that of the employer (null without one), and `name`, that of the words within the tenant."""
    placed = placed.withColumn("_words", F.array_join(F.sort_array(F.split("text", " ")), " "))  # sort_array is compiled, unlike array_sort
    words, named = F.col("_words"), F.col("text") != ""
    with_all = placed.withColumns(
        {
            "vertex": F.when(named, F.xxhash64("tenant", F.coalesce("employer", F.lit("?")), words)),
            "place": F.when(F.col("employer").isNotNull(), F.xxhash64("tenant", "employer")),
            "name": F.when(named, F.xxhash64("tenant", words)),
        }
    )
    return with_all.drop("_words")


def vertices(people: DataFrame) -> DataFrame:
    """(vertex, place, name, text) of the name classes; text holds the tokens in a typed order."""
    return people.groupBy("vertex").agg(*(F.min(c).alias(c) for c in ("place", "name", "text")))


def tokens_of(nodes: DataFrame) -> DataFrame:
    """(token, df): how many vertices have a token, by its occurrences."""
    return nodes.select(F.explode(F.split("text", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def weighted(nodes: DataFrame, frequency: DataFrame, total: int) -> DataFrame:
    """nodes with the weights of their tokens, a character each (see _quarters): log(1 + total / df)."""
    token = nodes.select("vertex", F.posexplode(F.split("text", " ")).alias("at", "token")).join(broadcast_if_small(frequency), "token")
    mark = F.char(F.lit(33) + F.floor(4 * F.least(F.log1p(F.lit(float(total)) / F.col("df")), F.lit(23.0))))  # a character per token travels cheaper than an array
    weights = token.groupBy("vertex").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", mark.alias("w")))), lambda x: x["w"]), "").alias("weights"))
    return nodes.join(weights, "vertex")


# Candidates.


def name_keys(nodes: DataFrame) -> DataFrame:
    """(key, vertex, size): the hashed q-grams of each vertex within its employer."""
    grams = nodes.filter("place is not null").select("vertex", "place", _name_grams("text").alias("grams"))
    return grams.select("vertex", "place", F.size("grams").alias("size"), F.explode("grams").alias("gram")).select(F.xxhash64("place", "gram").alias("key"), "vertex", "size")


def _meet(probes: DataFrame, keys: DataFrame, frequency: DataFrame, placed: DataFrame, finer: Callable, hot: int, sized: bool = False, counted: bool = False) -> DataFrame:
    """(place, a, b): probes (key, vertex) with the other vertices of keys (key, vertex) that share the key.

    placed: (place, vertex, text) the keys are made of. Keys of more than `hot` vertices are refined by finer(). sized:
    both have `size`, and a probe is only to meet vertices of its size and more. counted: both have `size` and all their
    keys, so vertices with too few usual keys in common are left out (those that share one of the others are found by finer()).
    """
    usual, over = frequency.filter(F.col("df").between(2, hot)).select("key"), frequency.filter(F.col("df") > hot).select("key")
    size = ["size"] if sized or counted else []
    a = probes.join(usual, "key").select("key", F.col("vertex").alias("a"), *(F.col(c).alias("sa") for c in size))
    b = keys.select("key", F.col("vertex").alias("b"), *(F.col(c).alias("sb") for c in size), *(["place"] if "place" in keys.columns else []))
    fits = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") != F.col("b"))) if sized else F.col("a") != F.col("b")
    columns = ["place", "a", "b"] if "place" in keys.columns else ["a", "b"]
    pairs = a.join(b, "key").filter(fits)
    if counted:  # a pair of probes is counted from either side, so some too many of these stay
        least = F.ceil(F.least(F.min("sa"), F.min("sb")) * OVERLAP)
        pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"), least.alias("least")).filter("n >= least")
    pairs = pairs.select(*columns)
    if not over.isEmpty():
        crowd = keys.join(broadcast_if_small(over), "key", "left_semi").select("vertex").distinct()
        parts = placed.join(crowd, "vertex", "left_semi").select("place", "vertex", F.explode(finer("text")).alias("x"))
        parts = parts.select("place", "vertex", F.xxhash64("place", "x.gram").alias("key"), "x.part", "x.role").join(broadcast_if_small(over), "key", "left_semi")
        parts = cut(parts.select("place", "vertex", "key", F.xxhash64("key", F.col("part")).alias("part"), "role"))
        mine = parts.join(probes.select("key", "vertex"), ["key", "vertex"], "left_semi").select("part", F.col("vertex").alias("a"), F.col("role").alias("ra"))
        other = parts.select("part", "place", F.col("vertex").alias("b"), F.col("role").alias("rb"))
        for x, y in ((0, (0,)), (1, (1, 2)), (2, (1,))):
            pairs = pairs.unionByName(mine.filter(F.col("ra") == x).join(other.filter(F.col("rb").isin(*y)), "part").filter("a <> b").select(*columns))
    return pairs.select(*columns[:-2], F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def meetings(probes: DataFrame, keys: DataFrame, frequency: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): probes (key, vertex, size), all of a vertex, with every vertex of keys that shares enough q-grams within the employer."""
    return _meet(probes, keys, frequency, nodes.select("place", "vertex", "text"), _finer_name_grams, HOT, counted=True)


def employer_candidates(nodes: DataFrame, keys: DataFrame, hot: int | None = None) -> DataFrame:
    """(a, b): pairs of vertices of one employer that share a q-gram among the rarest of the smaller set; q-grams only one vertex has are the rarest of all."""
    frequency = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    own = Window.partitionBy("vertex")
    ranked = keys.join(frequency, "key").withColumns({"at": F.row_number().over(own.orderBy("df", "key")), "met": F.count(F.lit(1)).over(own)})
    probes = ranked.filter(F.col("at") <= F.col("met") - F.ceil(F.col("size") * OVERLAP) + 1).select("key", "vertex", "size")
    return _meet(probes, keys, frequency, nodes.select("place", "vertex", "text"), _finer_name_grams, hot or HOT, sized=True)


def contact_uses(people: DataFrame) -> DataFrame:
    """(contact, vertex): which name classes use an address or a number of a tenant."""
    contact = F.array_compact(F.array(F.when(F.col("email_key").isNotNull(), F.xxhash64("tenant", F.lit("e"), "email_key")), F.when(F.col("phone_key").isNotNull(), F.xxhash64("tenant", F.lit("p"), "phone_key"))))
    return people.select("vertex", F.explode(contact).alias("contact")).distinct()


def contact_candidates(nodes: DataFrame, uses: DataFrame, mine: DataFrame | None = None, hot: int | None = None) -> DataFrame:
    """(contact, a, b): pairs of vertices (one of `mine`) with an e-mail address or phone number in common.

    Of a contact of more than `hot` vertices only those that share a variant of a token, without which names aren't alike.
    """
    hot = hot or HOT
    many = cut(uses.groupBy("contact").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    shared = uses.join(broadcast_if_small(many.filter(F.col("m") <= hot).select("contact")), "contact", "left_semi")
    asked = shared if mine is None else shared.join(mine, "vertex", "left_semi")
    pairs = asked.withColumnRenamed("vertex", "a").join(shared.withColumnRenamed("vertex", "b"), "contact").filter("a < b" if mine is None else "a <> b")
    pairs = pairs.select("contact", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs if mine is None else pairs.distinct()
    crowded = many.filter(F.col("m") > hot)
    if not crowded.isEmpty():
        crowd = uses.join(broadcast_if_small(crowded.select("contact")), "contact", "left_semi").join(nodes.select("vertex", "text"), "vertex")
        placed = cut(crowd.select(F.col("contact").alias("place"), "vertex", "text"))
        keys = placed.select("place", "vertex", F.explode(_contact_grams("text")).alias("gram"))
        keys = cut(keys.select("place", F.xxhash64("place", "gram").alias("key"), "vertex"))
        frequency = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
        probes = keys if mine is None else keys.join(mine, "vertex", "left_semi")
        pairs = pairs.unionByName(_meet(probes.select("key", "vertex"), keys, frequency, placed, _finer_contact_grams, hot).withColumnRenamed("place", "contact"))
    return pairs


def full_names(nodes: DataFrame) -> DataFrame:
    """Vertices with names of three and more full words."""
    return nodes.filter(F.size(F.filter(F.split("text", " "), lambda t: F.length(t) > 1)) >= 3)


def namesake_candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): vertices without an employer and vertices of the same words in the tenant; only names of three and more full words."""
    full = full_names(nodes)
    lone = full.filter("place is null").select("name", F.col("vertex").alias("a"))
    return lone.join(full.filter("place is not null").select("name", F.col("vertex").alias("b")), "name").select("a", "b")


# Decisions.


def _least_connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vertex, label) of all edges (a, b) of a partition."""
    ends = [[b.column(i).to_numpy() for i in (0, 1)] for b in batches if len(b)]
    if ends:
        a, b = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
        vertex, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        # Vertices are in order, so the smallest index is the smallest vertex; the roots of an edge's ends are joined until all ends have one.
        root = np.arange(len(vertex))
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(vertex[root])], ["vertex", "label"])


def components(edges: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(vertex, label): the smallest vertex of each connected component, for vertices that have an edge (a, b).

    Edges small enough to be broadcast go through one task instead, without rounds: these cost the driver a handful of
    shuffles and jobs each, whatever the number of edges.
    """
    edges = cut(edges.select("a", "b").dropna())
    if size_estimate(edges) <= limit:
        return cut(edges.coalesce(1).mapInArrow(_least_connected, "vertex long, label long"))
    both = cut(edges.select(F.col("a").alias("vertex"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("a").alias("to"))).distinct())
    labels = cut(both.groupBy("vertex").agg(F.least(F.min("to"), F.first("vertex")).alias("label")))
    for _ in range(ROUNDS):
        seen = both.join(labels.withColumnRenamed("vertex", "to"), "to").groupBy("vertex").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("vertex").alias("label"), F.col("label").alias("far"))
        fresh = cut(labels.join(seen, "vertex").join(jump, "label", "left").select("vertex", "label", F.least("label", "near", "far").alias("fresh")))
        moved = not fresh.filter("fresh < label").isEmpty()
        labels = fresh.select("vertex", F.col("fresh").alias("label"))
        if not moved:
            return labels
    raise RuntimeError(f"components not stable after {ROUNDS} rounds")


def verified(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, same_employer, contact, class, score, short) of candidate pairs with alike names; short is the vertex with fewer letters. nodes: weighted()."""
    side = lambda x: nodes.select(F.col("vertex").alias(x), *(F.col(c).alias(x + "_" + c) for c in ("text", "place", "weights")))
    known = pairs.join(side("a"), "a").join(side("b"), "b")
    got = known.withColumn("c", _compared("a_text", "b_text", "a_weights", "b_weights", "contact"))
    short = F.when((F.length("a_text") < F.length("b_text")) | ((F.length("a_text") == F.length("b_text")) & (F.col("a") < F.col("b"))), F.col("a")).otherwise(F.col("b"))
    same = F.coalesce(F.col("a_place") == F.col("b_place"), F.lit(False))
    return got.select("a", "b", same.alias("same_employer"), "contact", F.col("c.class").alias("class"), F.col("c.score").alias("score"), short.alias("short")).filter("class > 0")


def both_candidates(org: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b, contact): candidates by employer (a, b) and by contact (contact, a, b), each pair once."""
    every = org.select("a", "b", F.lit(False).alias("contact")).unionByName(shared.select("a", "b", F.lit(True).alias("contact")))
    return every.groupBy("a", "b").agg(F.max("contact").alias("contact"))


def office_contacts(uses: DataFrame, alike: DataFrame) -> DataFrame:
    """(contact): those more than OFFICE people use. alike: (contact, short): vertices that are alike to a fuller name of the contact."""
    people = uses.groupBy("contact").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > OFFICE)
    covered = alike.select("contact", "short").distinct().groupBy("contact").agg(F.count(F.lit(1)).alias("k"))
    return people.join(covered, "contact", "left").filter(F.col("m") - F.coalesce("k", F.lit(0)) > OFFICE).select("contact")


def evident(found: DataFrame, shared: DataFrame, office: DataFrame) -> DataFrame:
    """found with `contact` true only where a contact of (contact, a, b) is shared that is no office's; pairs with neither that nor the employer in common are left out."""
    personal = shared.join(broadcast_if_small(office), "contact", "left_anti").select("a", "b").distinct().withColumn("_own", F.lit(True))
    out = found.join(personal, ["a", "b"], "left").withColumn("contact", F.coalesce("_own", F.lit(False))).drop("_own")
    return out.filter("same_employer or contact")


def decided(found: DataFrame, namesakes: DataFrame) -> DataFrame:
    """(vertex, label) of vertices that are linked: sure links, then abbreviations (and names without an employer) that fit one class only."""
    first = components(found.filter(SURE).select("a", "b"))
    maybe = found.filter(MAYBE).select("short", F.when(F.col("short") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("long"))
    maybe = maybe.unionByName(namesakes.select(F.col("a").alias("short"), F.col("b").alias("long")))
    labelled = maybe.join(first.withColumnRenamed("vertex", "long"), "long", "left").withColumn("label", F.coalesce("label", "long"))
    single = labelled.groupBy("short").agg(F.min("label").alias("b"), F.max("label").alias("_other")).filter("b = _other and short <> b")
    # What is left joins classes: the second graph has a vertex per class an abbreviation belongs to, and no more.
    near = cut(single.join(first.withColumnRenamed("vertex", "short"), "short", "left").select("short", F.coalesce("label", "short").alias("a"), "b"))
    joined = components(near.select("a", "b").filter("a <> b")).select(F.col("vertex").alias("label"), F.col("label").alias("onto"))
    every = first.unionByName(near.select(F.col("short").alias("vertex"), F.col("a").alias("label"))).unionByName(near.select(F.col("b").alias("vertex"), F.col("b").alias("label"))).distinct()
    return every.join(joined, "label", "left").select("vertex", F.coalesce("onto", "label").alias("label")).distinct()


def _decide(links: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """decided() for whole groups of links (kind, a, b): kind 0 are sure, kind 1 have an abbreviation a that b may be meant by."""
    top: dict[int, int] = {}

    def root(v: int) -> int:
        top.setdefault(v, v)
        while top[v] != v:
            top[v] = v = top[top[v]]
        return v

    def join(pairs: Iterator[tuple[int, int]]) -> None:
        for a, b in pairs:
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)

    rows = [x for pdf in links for x in zip(pdf["kind"], pdf["a"], pdf["b"])]
    join((a, b) for kind, a, b in rows if kind == 0)
    fits: dict[int, set[int]] = {}
    for kind, a, b in rows:
        if kind == 1:
            fits.setdefault(a, set()).add(root(b))
    join([(a, next(iter(b))) for a, b in fits.items() if len(b) == 1])
    yield pd.DataFrame([(v, root(v)) for v in list(top)], columns=["vertex", "label"], dtype="int64")


def decided_by_group(found: DataFrame, namesakes: DataFrame, groups: DataFrame, most: int | None = None) -> DataFrame:
    """decided() where the connected groups (vertex, label) of all pairs are known: a partition of whole groups is decided in one pass; groups of more than `most` pairs by decided() itself."""
    of = groups.select(F.col("vertex").alias("a"), F.col("label").alias("_group"))
    found, namesakes = cut(found.join(of, "a")), cut(namesakes.join(of, "a"))
    large = found.groupBy("_group").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > (GROUP if most is None else most)).select("_group")
    some = not large.isEmpty()
    small = [df.join(broadcast_if_small(large), "_group", "left_anti") if some else df for df in (found, namesakes)]
    other = F.when(F.col("short") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    links = small[0].filter(SURE).select("_group", F.lit(0).alias("kind"), "a", "b").unionByName(small[0].filter(MAYBE).select("_group", F.lit(1).alias("kind"), F.col("short").alias("a"), other.alias("b")))
    links = links.unionByName(small[1].select("_group", F.lit(1).alias("kind"), "a", "b"))
    out = links.repartition("_group").select("kind", "a", "b").mapInPandas(_decide, "vertex long, label long")
    if some:
        out = out.unionByName(decided(*(df.join(large, "_group", "left_semi") for df in (found, namesakes))))
    return out


def link_people(people: DataFrame) -> DataFrame:
    """(vertex, label): the person each name class stands for. people: rows with a name, with vertices."""
    plain = cut(vertices(people))
    nodes = cut(weighted(plain, tokens_of(plain), plain.count()))
    uses = cut(contact_uses(people))
    shared = cut(contact_candidates(nodes, uses))
    pairs = both_candidates(employer_candidates(nodes, cut(name_keys(nodes))), shared)
    found = cut(verified(nodes, pairs))
    links = cut(shared.join(found.select("a", "b", "short"), ["a", "b"]))
    joined = decided(cut(evident(found, links, office_contacts(uses, links))), namesake_candidates(nodes))
    return nodes.select("vertex").join(joined, "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("label"))


def placed_rows(rows: DataFrame) -> DataFrame:
    """parse_rows() with employers and vertices, by all the rows."""
    parsed = cut(parse_rows(rows))
    kinds = cut(core_kinds(parsed))
    counts = cut(kinds.groupBy("tenant", "core").agg(F.sum("n").alias("n")))
    spelt = cut(spelling_roots(counts, cut(near_cores(counts, core_pieces(counts)))))
    return cut(with_vertices(with_employers(parsed, spelt, usual_kinds(kinds, spelt))))


def classes(rows: DataFrame) -> DataFrame:
    """(row_id, tenant, kind, class_id, spelling): the person (kind 'person') or else organisation each row names, and the hash of how it is spelt.

    Rows that name neither are left out.
    """
    placed = placed_rows(rows)
    people = placed.filter("vertex is not null")
    person = people.join(link_people(people), "vertex").select("row_id", "tenant", F.lit("person").alias("kind"), F.col("label").alias("class_id"), F.col("name_hash").alias("spelling"))
    office = placed.filter("vertex is null and core <> '' and employer is not null")
    return person.unionByName(office.select("row_id", "tenant", F.lit("organization").alias("kind"), F.xxhash64("tenant", "employer").alias("class_id"), F.col("organization_hash").alias("spelling")))


def class_members(rows: DataFrame) -> DataFrame:
    """(row_id, tenant, kind, class_id, n_links): every row's class and the number of rows of it that are spelt differently.

    The links of a class in one row each: counted per class and spelling, so a class of very many rows is joined with as many numbers as it has spellings.
    """
    named = cut(classes(rows))
    group = ["tenant", "kind", "class_id"]
    same = named.groupBy(*group, "spelling").agg(F.count(F.lit(1)).alias("_same"))
    whole = same.groupBy(*group).agg(F.sum("_same").alias("_all"))
    linked = same.join(whole, group).select(*group, "spelling", (F.col("_all") - F.col("_same")).alias("n_links"))
    return named.join(linked, [*group, "spelling"]).select("row_id", *group, "n_links")


def as_rows(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").alias("row_id"), F.col("organization_id").alias("tenant"), "full_name", "organization", "email", "phone")


def variant_pairs(records: DataFrame) -> DataFrame:
    """(record_a, record_b): records of one tenant that name the same person, or for rows without a name the same organisation, spelt differently.

    As many rows as there are pairs, as the definition asks; class_members() has the same links in one row per record.
    """
    named = cut(classes(as_rows(records)).select(F.xxhash64("tenant", "kind", "class_id").alias("class"), "row_id", "spelling"))
    a = named.select("class", F.col("row_id").alias("record_a"), F.col("spelling").alias("_a"))
    b = named.select("class", F.col("row_id").alias("record_b"), F.col("spelling").alias("_b"))
    return a.join(b, "class").filter("record_a < record_b and _a <> _b").select("record_a", "record_b")
