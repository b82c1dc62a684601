"""Problem 4: deduplicating new batches against all history.

History is kept as hash tables in the shared folder, bucketed by the hash they are probed with, and append-only; what can
change is kept as counts that are added up. For a batch, bucket-local semi-joins pick the entries whose hashes it has:

* content: the hash of a row's normalised text, and of each of its paragraphs (parts): full copies and coverage (copies());
* the vertex of people.py: the hash of tenant, employer and name words, so equal ones are copies of a person's entry;
* its paragraphs: q-grams of the name within the employer, and the whole name within the tenant;
* contacts: e-mail address and phone number.

Only vertices and contacts that are new are compared with what they meet. Pairs of alike names are kept, and so is the
group (connected component of alike pairs) of every vertex. A batch is decided by the rules of people.py on the whole
groups it touches: groups are independent of each other, so each decision is that of a joint run over all rows so far.
Everything a decision uses covers all rows so far: tokens and employers' spellings are counted in tables of their own. If
a batch changes which employer an old spelling or type belongs to, the rows of that spelling are read again and move.

match() returns the pairings a batch establishes: of its own rows, and of earlier rows (at least one of a batch) whose
persons turn out to be one. So whatever the cuts, after each batch all pairings of the joint run over the rows so far
have come out. A pairing that later rows make doubtful isn't taken back.

Defined results: null and blank fields are no evidence; repeated rows and ids pair like any other rows (a row never
with itself); empty batches and an empty history give no pairs; rows without a batch number come first; created_at is not
used; extra columns are ignored.
"""

from __future__ import annotations

import gc
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.text import cell
from rollcall.llm import people
from rollcall.session import BROADCAST_BYTES, broadcast_if_small, checkpoint_dir, cut, size_estimate

#: Rows of history a bucket is made for.
BUCKET_ROWS = 25_000
#: Consecutive batches that together are less than this part of history are taken in one step, which costs the same few dozen jobs for any number of rows.
STEP = 12
# What is kept: the hash an entry is found by, and its columns.
PARTS = {
    "cores": ("ckey", "tenant string, core string, kind string, n long"),
    "pieces": ("key", "tenant string, core string"),
    "near": ("ckey", "tenant string, core string, other string"),
    "rows": ("ckey", "row_id string, tenant string, core string, kind string, host string, text string, email_key string, phone_key string, incoming boolean"),
    "nodes": ("vertex", "place long, name long, text string, n long"),
    "members": ("vertex", "row_id string, incoming boolean, n long"),
    "tokens": ("tkey", "token string, n long"),
    "keys": ("key", "vertex long, size int"),
    "contacts": ("contact", "vertex long, n long"),
    "alike": ("a", "b long, contact long"),
    "covers": ("contact", "short long, long long"),
    "groups": ("vertex", "label long, class long, batch int"),
    "group_members": ("label", "vertex long"),
}
NODE = ("vertex", "place", "name", "text")
NAMED = ("row_id", "tenant", *NODE, "email_key", "phone_key", "incoming")
#: The parts of many columns, kept in a table of their own: each row is written with the columns of all parts of its table.
WIDE = ("rows",)
#: Bytes of a bucket's hashes, by size_estimate(), that a task may hold as a table while it reads the bucket.
BUCKET_BYTES = 32 << 20


def _slots(part: str) -> list[tuple[str, str, str]]:
    """(column, its kind, the table's column it is kept in): parts share s0, s1 ... for texts and n0, n1 ... for all else, since each row is written with the columns of all parts of its table."""
    out, used = [], {"s": 0, "n": 0}
    for c in PARTS[part][1].split(", "):
        name, kind = c.split()
        mark = "s" if kind == "string" else "n"
        out.append((name, kind, f"{mark}{used[mark]}"))
        used[mark] += 1
    return out


@dataclass
class History:
    """Hash tables in a folder all executors share: the parts of two tables (WIDE and the rest), bucketed by hash, so that a batch is appended in two jobs."""

    spark: SparkSession
    buckets: int = 8
    name: str = field(default_factory=lambda: "history_" + uuid.uuid4().hex[:12])
    batches: int = 0
    rows: int = 0
    vertices: int = 0

    def _table(self, part: str) -> str:
        return f"{self.name}_wide" if part in WIDE else self.name

    def _path(self, table: str) -> str:
        return f"{checkpoint_dir(self.spark)}/{table}"

    def add(self, parts: dict[str, DataFrame]) -> None:
        for kept in ([p for p in PARTS if p not in WIDE], WIDE):
            self._add({p: parts[p] for p in kept})

    def _add(self, parts: dict[str, DataFrame]) -> None:
        slots = sorted({slot for part in parts for _, _, slot in _slots(part)})
        name, long = self._table(next(iter(parts))), None
        for part, df in parts.items():
            own = {slot: F.col(c) for c, _, slot in _slots(part)}
            one = df.select(F.lit(part).alias("part"), F.col(PARTS[part][0]).cast("long").alias("hash"), *(own.get(x, F.lit(None)).cast("string" if x[0] == "s" else "long").alias(x) for x in slots))
            long = one if long is None else long.unionByName(one)
        table = long.repartition(self.buckets, "hash").write.mode("append").partitionBy("part").bucketBy(self.buckets, "hash")
        # A task has one bucket, so it keeps a file of each part open rather than sort all rows by part.
        conf, key = self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(key)
        conf.set(key, len(parts))
        try:
            table.option("path", self._path(name)).format("parquet").saveAsTable(name)
        finally:
            conf.set(key, before)

    def read(self, part: str) -> DataFrame:
        return self.spark.table(self._table(part)).filter(F.col("part") == part).select(F.col("hash").alias(PARTS[part][0]), *(F.col(slot).cast(kind).alias(c) for c, kind, slot in _slots(part)))

    def touched(self, part: str, hashes: DataFrame) -> DataFrame:
        """The entries whose hash is among `hashes`, a table of that one column. A bucket's hashes are held as a table where they fit, so that history needn't be sorted for each batch."""
        asked = hashes.distinct()
        if size_estimate(asked) <= BUCKET_BYTES * self.buckets:
            asked = asked.hint("shuffle_hash")
        return self.read(part).join(asked, hashes.columns[0], "left_semi")

    def drop(self) -> None:
        """Deletes the tables; results that read them must have been written."""
        for name in {self._table(part) for part in PARTS}:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _tidy(spark: SparkSession) -> None:
    """Lets the driver give back what some dozen jobs leave there: plans, compiled stages and broadcast tables, which go with a collection only, and native memory that the allocator keeps for each of their hundreds of threads until it is asked for it."""
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        _trim(spark)
    except Py4JError:  # a Java or a system without this command
        pass


def _trim(spark: SparkSession) -> None:
    """Java's own command System.trim_native_heap, called as a management operation: its class may only be reached through the interface."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.Class, 4), array(jvm.Object, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = jvm.Class.forName(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def _ckey(core: str = "core") -> F.Column:
    return F.xxhash64("tenant", core)


def _counts(kinds: DataFrame) -> DataFrame:
    return kinds.groupBy("tenant", "core").agg(F.sum("n").alias("n"))


def _parsed(rows: DataFrame) -> DataFrame:
    """people.parse_rows() with the hash of the core that places a row: its own, or else its address's host."""
    place = F.when(F.col("core") != "", F.col("core")).when(F.col("host") != "", F.col("host"))
    return people.parse_rows(rows).drop("name_hash", "organization_hash").withColumn("ckey", F.when(place.isNotNull(), F.xxhash64("tenant", place)))


def _met(pieces: DataFrame) -> DataFrame:
    """pieces, broadcast if they are few or else merged with their probes: these are some dozen times as many as the cores they are made of, which the optimizer takes for small enough to be broadcast."""
    few = broadcast_if_small(pieces)
    return few if few is not pieces else pieces.hint("merge")


def _places(kinds: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spellings with the core they stand for, usual types) of counted spellings."""
    spelt = cut(people.spelling_roots(cut(_counts(kinds)), near))
    return spelt, cut(people.usual_kinds(kinds, spelt))


def _best_spellings(counts: DataFrame, near: DataFrame) -> DataFrame:
    """(tenant, core, was_core, now_core): the most frequent of a core and its neighbours (the first in the alphabet of several), before and now; was_core is null for new spellings.

    counts: (tenant, core, was, n), near: (tenant, core, other, was). Cores are met by their hashes; a core is a candidate for itself.
    """
    own = counts.select(_ckey().alias("ckey"), F.col("core").alias("other"), F.when(F.col("was") > 0, F.col("was")).alias("was_n"), F.col("n").alias("now_n"))
    pairs = near.select(_ckey().alias("ckey"), F.xxhash64("tenant", "other").alias("to"), "was").join(own.withColumnRenamed("ckey", "to"), "to")
    every = own.unionByName(pairs.select("ckey", "other", F.when(F.col("was"), F.col("was_n")).alias("was_n"), "now_n"))
    first = lambda run: F.min(F.when(F.col(run + "_n").isNotNull(), F.struct((-F.col(run + "_n")).alias("n"), "other"))).getField("other").alias(run + "_core")
    return counts.select("tenant", "core", _ckey().alias("ckey")).join(every.groupBy("ckey").agg(first("was"), first("now")), "ckey").select("tenant", "core", "was_core", "now_core")


def _both_places(kinds: DataFrame, near: DataFrame) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """_places() before and now, in one run: kinds (tenant, core, kind, was, n) and near (tenant, core, other, was) with what was there before. Each pair of spellings is looked at once for both."""
    run = lambda df, mark, *c: df.select(F.concat(F.lit(mark + " "), "tenant").alias("tenant"), *c)
    kinds = cut(kinds)
    best = cut(_best_spellings(cut(kinds.groupBy("tenant", "core").agg(F.sum("was").alias("was"), F.sum("n").alias("n"))), near))
    best = run(best, "now", "core", F.col("now_core").alias("to_core")).unionByName(run(best.filter("was_core is not null"), "was", "core", F.col("was_core").alias("to_core")))
    counted = run(kinds, "now", "core", "kind", "n").unionByName(run(kinds.filter("was > 0"), "was", "core", "kind", F.col("was").alias("n")))
    spelt = cut(people.with_ends(best.select("tenant", "core"), cut(best.filter("core <> to_core"))))
    places = spelt, cut(people.usual_kinds(counted, spelt))
    of = lambda mark: tuple(df.filter(F.col("tenant").startswith(mark)).withColumn("tenant", F.substring(F.col("tenant"), 5, 1 << 30)) for df in places)
    return of("was "), of("now ")


def _placed(rows: DataFrame, places: tuple[DataFrame, DataFrame]) -> DataFrame:
    return people.with_vertices(people.with_employers(rows, *places))


def _name_keys(nodes: DataFrame) -> DataFrame:
    """Paragraph hashes: q-grams of the name within the employer, and full names within the tenant (of size 0)."""
    whole = people.full_names(nodes).select(F.xxhash64(F.lit("name"), "name").alias("key"), "vertex", F.lit(0).alias("size"))
    return people.name_keys(nodes).unionByName(whole)


def _live_nodes(counted: DataFrame) -> DataFrame:
    """Vertices that have rows, from counted (NODE, n); the text is the first of those typed."""
    return _node_states(counted.withColumn("was", F.lit(0))).filter("live").select(*NODE)


def _node_states(counted: DataFrame) -> DataFrame:
    """(NODE, before, live): vertices counted (NODE, was, n), whether they had rows before and have rows now."""
    texts = counted.groupBy("vertex", "text").agg(*(F.first(c).alias(c) for c in ("place", "name")), F.sum("was").alias("was"), F.sum("n").alias("n"))
    text = F.coalesce(F.min(F.when(F.col("n") > 0, F.col("text"))), F.min("text")).alias("text")
    return texts.groupBy("vertex").agg(text, *(F.min(c).alias(c) for c in ("place", "name")), F.max(F.col("was") > 0).alias("before"), F.max(F.col("n") > 0).alias("live"))


def _node_counts(placed: DataFrame, n: int = 1) -> DataFrame:
    """(NODE, n) of placed rows with a name: which texts a vertex has, and in how many rows."""
    return placed.groupBy(*NODE).agg((F.lit(n) * F.count(F.lit(1))).alias("n"))


def _use_counts(placed: DataFrame, n: int = 1) -> DataFrame:
    contact = F.array(F.when(F.col("email_key").isNotNull(), F.xxhash64("tenant", F.lit("e"), "email_key")), F.when(F.col("phone_key").isNotNull(), F.xxhash64("tenant", F.lit("p"), "phone_key")))
    return placed.select("vertex", F.explode(contact).alias("contact")).filter("contact is not null").groupBy("contact", "vertex").agg((F.lit(n) * F.count(F.lit(1))).alias("n"))


def _new_nodes(counted: DataFrame) -> DataFrame:
    """_live_nodes() of counted (NODE, n) with each text of a vertex once and n above 0, as _node_counts() gives it."""
    return counted.groupBy("vertex").agg(*(F.min(c).alias(c) for c in NODE[1:]))


def _live(counted: DataFrame, *by: str) -> DataFrame:
    return counted.groupBy(*by).agg(F.sum("n").alias("n")).filter("n > 0").select(*by)


def _counted_tokens(nodes: DataFrame) -> DataFrame:
    return people.tokens_of(nodes).select(F.xxhash64("token").alias("tkey"), "token", F.col("df").alias("n"))


def _unweighted(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("weights", F.lit(""))


def _alike(nodes: DataFrame, org: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alike (a, b, contact), covers (contact, short, long)) of candidates: pairs whose names are alike, whatever their weights."""
    found = cut(people.verified(_unweighted(nodes), people.both_candidates(org, shared)).select("a", "b", "short", "same_employer"))
    by_contact = shared.join(found.select("a", "b", "short"), ["a", "b"])
    both = found.filter("same_employer").select("a", "b", F.lit(None).cast("bigint").alias("contact")).unionByName(by_contact.select("a", "b", "contact"))
    return cut(both), by_contact.select("contact", "short", F.when(F.col("short") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("long"))


def start(rows: DataFrame) -> History:
    """A history of rows (row_id, tenant, full_name, organization, email, phone)."""
    parsed = cut(_parsed(rows).withColumn("incoming", F.lit(False)))
    n = parsed.count()
    history = History(rows.sparkSession, min(4096, max(rows.sparkSession.sparkContext.defaultParallelism, n // BUCKET_ROWS)), rows=n)
    kinds = cut(people.core_kinds(parsed))
    pieces = cut(people.core_pieces(_counts(kinds)))
    near = cut(people.near_cores(_counts(kinds), _met(pieces)))
    _tidy(history.spark)
    placed = cut(_placed(parsed.filter("text <> ''"), _places(kinds, near)).select(*NAMED))
    counted = cut(_node_counts(placed))
    nodes = cut(_new_nodes(counted))
    uses = cut(_use_counts(placed))
    keys = cut(_name_keys(nodes))
    history.vertices = nodes.count()
    _tidy(history.spark)
    shared = cut(people.contact_candidates(nodes, uses.select("contact", "vertex")))
    alike, covers = _alike(nodes, people.employer_candidates(nodes, keys.filter("size > 0")), shared)
    groups = people.components(alike.select("a", "b").unionByName(people.namesake_candidates(nodes)))
    _tidy(history.spark)
    tables = {
        "cores": kinds.withColumn("ckey", _ckey()), "pieces": pieces, "near": near.withColumn("ckey", _ckey()), "rows": parsed, "nodes": counted, "tokens": _counted_tokens(nodes), "keys": keys,
        "members": placed.select("vertex", "row_id", "incoming", F.lit(1).alias("n")), "contacts": uses, "alike": alike, "covers": covers, "group_members": groups,
        "groups": groups.select("vertex", "label", F.lit(None).cast("bigint").alias("class"), F.lit(0).alias("batch")),
    }
    history.add(tables)
    return history


def _spelling_trees(history: History, parsed: DataFrame, near: DataFrame) -> DataFrame:
    """(ckey): the spellings a batch's rows are placed by, and all that are connected with them by likeness."""
    seen = parsed.filter("ckey is not null").select("ckey").distinct()
    known = history.read("near").select("ckey")
    if size_estimate(known) <= BROADCAST_BYTES:  # so few that all of them may be taken along: more spellings than needed change nothing
        return cut(seen.unionByName(known).unionByName(near.select(_ckey().alias("ckey"))).distinct())
    seen = cut(seen)
    edges = history.read("near").select("ckey", F.xxhash64("tenant", "other").alias("to")).unionByName(near.select(_ckey().alias("ckey"), F.xxhash64("tenant", "other").alias("to")))
    last = seen
    while True:
        last = cut(edges.join(broadcast_if_small(last), "ckey", "left_semi").select(F.col("to").alias("ckey")).distinct().join(seen, "ckey", "left_anti"))
        if last.isEmpty():
            return seen
        seen = cut(seen.unionByName(last))


def _moved(history: History, before: tuple[DataFrame, DataFrame], now: tuple[DataFrame, DataFrame], fresh: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(rows of history whose vertex a batch changes, as they were; the same as they are now), or None if there are none. fresh: spellings (tenant, core) the batch brings."""
    side = lambda p: p[0].join(p[1], ["tenant", "to_core"], "left").select("tenant", "core", "to_core", F.coalesce("usual", F.lit("")).alias("usual"))
    known = side(before).withColumnsRenamed({"to_core": "_t", "usual": "_u"})
    changed = side(now).join(known, ["tenant", "core"]).filter("to_core <> _t or usual <> _u").select("tenant", "core").unionByName(fresh.select("tenant", "core"))
    dirty = cut(history.touched("rows", changed.select(_ckey().alias("ckey"))))
    if dirty.isEmpty():
        return None
    was = _placed(dirty, before).select("row_id", F.col("vertex").alias("_was"))
    both = cut(_placed(dirty, now).join(was, "row_id").filter("vertex is not null and not (vertex <=> _was)"))
    if both.isEmpty():
        return None
    old = cut(_placed(dirty, before).join(both.select("row_id"), "row_id", "left_semi"))
    return old, both.drop("_was")


def match(history: History, batch: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """((row_a, row_b), what append() takes): the pairings a batch (row_id, tenant, full_name, organization, email, phone) establishes."""
    parsed = cut(_parsed(batch).withColumn("incoming", F.lit(True)))
    kinds = cut(people.core_kinds(parsed))
    known = history.touched("cores", kinds.select(_ckey().alias("ckey")))
    fresh = cut(_counts(kinds).join(broadcast_if_small(known.select("tenant", "core").distinct()), ["tenant", "core"], "left_anti"))
    pieces = people.core_pieces(fresh)
    one = people.near_cores(fresh, _met(history.read("pieces").unionByName(pieces)))
    ways = F.explode(F.array(F.struct("core", "other"), F.struct(F.col("other").alias("core"), F.col("core").alias("other"))))
    near = cut(one.select("tenant", ways.alias("w")).select("tenant", "w.core", "w.other").distinct())
    trees = _spelling_trees(history, parsed, near)
    _tidy(history.spark)
    every = history.touched("cores", trees).select("tenant", "core", "kind", F.col("n").alias("was"), "n").unionByName(kinds.select("tenant", "core", "kind", F.lit(0).cast("bigint").alias("was"), "n"))
    pairs = history.touched("near", trees).select("tenant", "core", "other", F.lit(True).alias("was")).unionByName(near.withColumn("was", F.lit(False)))
    before, now = _both_places(every.groupBy("tenant", "core", "kind").agg(F.sum("was").alias("was"), F.sum("n").alias("n")), pairs)
    _tidy(history.spark)
    moved = _moved(history, before, now, fresh)
    named = _placed(parsed.filter("text <> ''"), now).select(*NAMED)
    if moved:
        named = named.unionByName(moved[1].select(*NAMED))
    named = cut(named)
    gone = moved[0].filter("vertex is not null").select(*NAMED) if moved else None

    counted, uses = _node_counts(named), _use_counts(named)
    members = named.select("vertex", "row_id", "incoming", F.lit(1).alias("n"))
    if moved:
        counted, uses = counted.unionByName(_node_counts(gone, -1)), uses.unionByName(_use_counts(gone, -1))
        members = members.unionByName(gone.select("vertex", "row_id", "incoming", F.lit(-1).alias("n")))
    counted, uses = cut(counted), cut(uses)
    old = history.touched("nodes", counted.select("vertex")).select(*NODE, F.col("n").alias("was"), "n")
    state = cut(_node_states(old.unionByName(counted.select(*NODE, F.lit(0).cast("bigint").alias("was"), "n"))))
    born, dead = state.filter("live and not before"), state.filter("before and not live")
    tokens = _counted_tokens(born).unionByName(_counted_tokens(dead).withColumn("n", -F.col("n")))
    total = history.vertices + state.select(F.coalesce(F.sum(F.when(F.col("live"), 1).otherwise(0) - F.when(F.col("before"), 1).otherwise(0)), F.lit(0))).first()[0]

    # What is new meets what has its hashes.
    _tidy(history.spark)
    keys = cut(_name_keys(born))
    met = cut(history.touched("keys", keys.select("key")).unionByName(keys).distinct())
    used = history.touched("contacts", uses.select("contact")).select("contact", "vertex", F.col("n").alias("was"), "n").unionByName(uses.select("contact", "vertex", F.lit(0).cast("bigint").alias("was"), "n"))
    used = cut(used.groupBy("contact", "vertex").agg(F.sum("was").alias("was"), F.sum("n").alias("n")).filter("n > 0"))
    ids = met.select("vertex").unionByName(used.select("vertex"))
    near_nodes = cut(_live_nodes(history.touched("nodes", ids).select(*NODE, "n").unionByName(counted.select(*NODE, "n"))))
    grams = met.filter("size > 0")
    frequency = cut(grams.groupBy("key").agg(F.count(F.lit(1)).alias("df")))
    org = people.meetings(keys.filter("size > 0"), grams, frequency, near_nodes)
    _tidy(history.spark)
    shared = cut(people.contact_candidates(near_nodes, used.select("contact", "vertex"), used.filter("was <= 0").select("vertex").distinct()))
    alike, covers = _alike(near_nodes, org, shared)
    names = met.filter("size = 0").select("vertex").distinct()
    namesakes = people.namesake_candidates(near_nodes.join(names, "vertex", "left_semi"))

    # The groups it touches, whole.
    _tidy(history.spark)
    edges = cut(alike.select("a", "b").unionByName(namesakes))
    touched = counted.select("vertex").union(edges.select("a")).union(edges.select("b")).distinct()
    latest = lambda df: df.groupBy("vertex").agg(F.max_by(F.struct("label", "class"), "batch").alias("g")).select("vertex", "g.label", "g.class")
    known = latest(history.touched("groups", touched))
    star = history.touched("group_members", known.select("label")).filter("vertex <> label").select(F.col("vertex").alias("a"), F.col("label").alias("b"))
    groups = people.components(edges.unionByName(star))
    whole = cut(groups.select("vertex").unionByName(touched).distinct())
    nodes = _live_nodes(history.touched("nodes", whole).select(*NODE, "n").unionByName(counted.select(*NODE, "n")))
    nodes = cut(nodes.join(whole, "vertex", "left_semi"))
    bag = nodes.select(F.explode(F.split("text", " ")).alias("token")).select(F.xxhash64("token").alias("tkey"))
    frequency = history.touched("tokens", bag).unionByName(tokens).groupBy("token").agg(F.sum("n").alias("df"))
    links = history.touched("alike", whole.select(F.col("vertex").alias("a"))).unionByName(alike)
    links = cut(links.distinct().join(nodes.select(F.col("vertex").alias("a")), "a", "left_semi").join(nodes.select(F.col("vertex").alias("b")), "b", "left_semi"))
    contacts = links.filter("contact is not null").select("contact").distinct()
    every_use = cut(_live(history.touched("contacts", contacts).unionByName(uses.join(contacts, "contact", "left_semi")), "contact", "vertex"))
    shared = _using(links.filter("contact is not null"), every_use, "a", "b")
    covered = _using(history.touched("covers", contacts).unionByName(covers), every_use, "short", "long")
    pairs = people.both_candidates(links.filter("contact is null"), shared)
    _tidy(history.spark)
    found = people.evident(people.verified(people.weighted(nodes, frequency, total), pairs), shared, people.office_contacts(every_use, covered))
    labels = people.decided_by_group(found, people.namesake_candidates(nodes), groups)
    labels = cut(nodes.select("vertex").join(labels, "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("class")))

    # Pairings that weren't there before.
    _tidy(history.spark)
    was = latest(history.touched("groups", whole)).select("vertex", F.coalesce("class", "vertex").alias("was"))
    old_rows = history.touched("members", whole)
    if moved:
        old_rows = _live(old_rows.unionByName(gone.select("vertex", "row_id", "incoming", F.lit(-1).alias("n"))), "vertex", "row_id", "incoming")
    old_rows = old_rows.select("vertex", "row_id", "incoming").join(was, "vertex", "left").select("vertex", "row_id", "incoming", F.coalesce("was", "vertex").alias("was"))
    rows = old_rows.unionByName(named.select("vertex", "row_id", "incoming", F.lit(None).cast("bigint").alias("was"))).join(labels, "vertex")
    rows = cut(rows.select("class", "row_id", "incoming", "was"))
    a = rows.filter("incoming").select("class", F.col("row_id").alias("x"), F.col("was").alias("_a"))
    b = rows.select("class", F.col("row_id").alias("y"), F.col("was").alias("_b"), F.col("incoming").alias("_i"))
    new = a.join(b, "class").filter("x <> y and (not _i or x < y) and (_a is null or _b is null or _a <> _b)")
    found = cut(new.select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b")).distinct())
    whole_labels = nodes.select("vertex").join(groups, "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("label")).join(labels, "vertex")
    return found, {
        "cores": kinds.withColumn("ckey", _ckey()), "pieces": pieces, "near": near.withColumn("ckey", _ckey()), "rows": parsed, "nodes": counted, "members": members, "tokens": tokens, "keys": keys,
        "contacts": uses, "alike": alike, "covers": covers, "groups": whole_labels.withColumn("batch", F.lit(history.batches + 1)), "group_members": groups,
        "total": total,
    }


def _using(links: DataFrame, uses: DataFrame, x: str, y: str) -> DataFrame:
    """Links (contact, x, y) of which both still use the contact."""
    for c in (x, y):
        links = links.join(uses.select("contact", F.col("vertex").alias(c)), ["contact", c], "left_semi")
    return links.select("contact", x, y)


def append(history: History, new: dict[str, DataFrame]) -> None:
    """Appends what match() found for a batch."""
    history.add(new)
    history.batches += 1
    history.vertices = new["total"]


def as_rows(records: DataFrame) -> DataFrame:
    return people.as_rows(records)


def steps(counts: list[tuple[int, int]], known: int, part: int = STEP) -> list[list[int]]:
    """Batch numbers, in order, as steps of consecutive batches: counts are (number, rows), known the rows of history."""
    out, room = [], 0
    for number, n in sorted(counts):
        if n > room:
            out.append([])
            room = known // part
        out[-1].append(number)
        room -= n
        known += n
    return out


def batch_pairs(records: DataFrame, incoming: DataFrame, part: int = STEP) -> DataFrame:
    """(record_a, record_b): all pairings of incoming rows with records, earlier batches and each other.

    Batches are taken in order of batch_no, each matched against all accepted before and then appended; small ones that
    follow each other in one step (see steps()), which gives the same pairings. The batch numbers and their rows are read
    on the driver; the history is dropped at the end.
    """
    first = F.lit(-(1 << 31))
    incoming = incoming.withColumn("_batch", F.coalesce("batch_no", first) if "batch_no" in incoming.columns else first)
    history = start(as_rows(records))
    _tidy(history.spark)
    order = steps([tuple(r) for r in incoming.groupBy("_batch").count().collect()], history.rows, part)
    found = []
    try:
        for step in order:
            pairs, new = match(history, as_rows(incoming.filter(F.col("_batch").between(step[0], step[-1]))))
            found.append(pairs)
            if step is not order[-1]:
                append(history, new)
            del new
            _tidy(history.spark)
    finally:
        history.drop()
    none = records.sparkSession.createDataFrame([], "row_a string, row_b string")
    every = reduce(DataFrame.unionByName, found, none).distinct()
    return every.select(F.col("row_a").alias("record_a"), F.col("row_b").alias("record_b"))


def copies(records: DataFrame, incoming: DataFrame) -> DataFrame:
    """(record_id, batch_no, is_copy, coverage) of every incoming row: whether a record or a row of an earlier batch of the tenant has the same normalised text, and the share of its paragraphs found in those.

    Content and paragraph hashes of all rows with the number of the first batch they came in are aggregated on the map
    side, so a text a third of all rows has is one row per task; a row is compared with that number only. Texts are
    compared without case and edges; empty texts have no paragraphs, their coverage is 0.
    """
    first = F.lit(-(1 << 31))
    text = F.lower(cell("normalized_text"))
    old = records.select("organization_id", first.alias("batch_no"), text.alias("text"))
    mine = incoming.select(F.col("id").alias("record_id"), "organization_id", F.coalesce("batch_no", first + 1).alias("batch_no"), F.col("batch_no").alias("_no"), text.alias("text"))
    hashed = lambda df, *c: df.select(*c, F.xxhash64("organization_id", "text").alias("content"), F.transform(F.filter(F.array_distinct(F.split("text", " \\| ")), lambda p: p != ""), lambda p: F.xxhash64("organization_id", p)).alias("parts"))
    every = hashed(old.unionByName(mine.select("organization_id", "batch_no", "text")), "batch_no")
    contents = every.groupBy("content").agg(F.min("batch_no").alias("_c"))
    parts = every.select("batch_no", F.explode("parts").alias("part")).groupBy("part").agg(F.min("batch_no").alias("_p"))
    asked = hashed(mine, "record_id", "batch_no", "_no")
    seen = asked.select("record_id", "batch_no", F.explode("parts").alias("part")).join(parts, "part").groupBy("record_id", "batch_no").agg((F.count_if(F.col("_p") < F.col("batch_no")) / F.count(F.lit(1))).alias("coverage"))
    return asked.join(contents, "content").join(seen, ["record_id", "batch_no"], "left").select("record_id", F.col("_no").alias("batch_no"), (F.col("_c") < F.col("batch_no")).alias("is_copy"), F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"))
