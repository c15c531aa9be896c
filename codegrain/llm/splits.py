"""Problem 3: train, validation and test splits that keep families of records together.

Families are the connected components of owners.  Components of identical size and label profile (the leading
label, and whether there are others) form a bundle; a min-cost flow over labels and splits decides how much of each label goes where at the least
deviation from the quotas; bundles take their whole numbers of components from it, the largest first,
each carrying its rounding error on to the next; members of a bundle are told apart by hash.

What the driver gets is one row per bundle.  Sizes that differ add up to no more than all records, so among N
records of L labels there are fewer than sqrt(8 N L) bundles, whatever the families are like.  The components
themselves and their links stay distributed; labels are taken to be a dimension, such as languages.

Defined results: a record without an owner (null path, or too few parts) is a family of its own; a null
label is the label ``?``; ids count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.operators.durable import durable
from codegrain.operators.graph import connected_components
from codegrain.operators.ordered import running_sum, salted_join

QUOTAS = {"train": 90, "val": 5, "test": 5}  # per cent
SINGLE = "=1"  # class of single records
RESERVE = 0.45  # share of the single records kept for each smaller split, to close what families leave open
BIG = 1 << 60


def owner_of_path(path: Column) -> Column:
    """First part of what follows ``raw/<language>/``, if an owner, a repository and a file name follow."""
    rest = F.regexp_extract(path, r"(?i)(?:^|[/\\])raw[/\\]+[^/\\]+[/\\]+(.+)$", 1)
    parts = F.split(rest, r"__|[/\\]")
    name = F.lower(F.trim(F.element_at(parts, 1)))
    return F.when((F.size(parts) >= 3) & (name != "") & (F.trim(F.element_at(parts, -1)) != ""), name)


def owner_of_slug(slug: Column) -> Column:
    """What stands before the slash, without regard to case and outer blanks."""
    name = F.lower(F.trim(F.regexp_extract(slug, r"^([^/]*)/", 1)))
    return F.when(name != "", name)


def owner_links(repos: DataFrame) -> DataFrame:
    """Pairs of owners tied by a fork or a change of name."""
    me = owner_of_slug(F.col("slug"))
    other = F.explode(F.array(owner_of_slug(F.col("parent_slug")), owner_of_slug(F.col("renamed_to"))))
    return repos.select(me.alias("a"), other.alias("b")).where("a is not null and b is not null and a <> b").distinct()


def families(files: DataFrame, repos: DataFrame, id_col: str, path_col: str, version_col: str | None, *carry: str) -> DataFrame:
    """``doc, family`` and the carried columns, one row per id; ``family`` is null without an owner."""
    version = F.col(version_col) if version_col else F.lit(0)
    row = F.struct(owner_of_path(F.col(path_col)).alias("owner"), *[F.col(c) for c in carry])
    one = files.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max_by(row, F.struct(version, F.xxhash64(row))).alias("x"))
    one = durable(one.select("doc", "x.owner", *[f"x.{c}" for c in carry]), "owners")
    comp = connected_components(owner_links(repos), "a", "b")
    owners = one.where("owner is not null").groupBy("owner").agg(F.count("*").alias("n"))
    owners = owners.join(comp.select(F.col("node").alias("owner"), "component"), "owner", "left")
    owners = durable(owners.select("owner", "n", F.coalesce("component", "owner").alias("family")), "owner-families")
    owned = salted_join(one.where("owner is not null"), owners, "owner", "n", total=one.count())
    cols = ["doc", "family", *carry]
    every = owned.select(*cols).union(one.where("owner is null").select("doc", F.lit(None).cast("string").alias("family"), *carry).select(*cols))
    return durable(every, "family-members")


def torn(fams: DataFrame, split_col: str) -> DataFrame:
    """Ids of the families that have records in two or more of the splits, without an allocation."""
    split = F.lower(F.trim(F.col(split_col)))
    known = fams.where("family is not null").select("doc", "family", F.when(split.isin(*QUOTAS), split).alias("s"))
    per = known.groupBy("family").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n"))
    hit = durable(per.where("lo < hi").select("family", "n"), "torn-families")
    return salted_join(known, hit, "family", "n", total=fams.count()).select("doc")


# ---------------------------------------------------------------------------- allocation


class Flow:
    """Successive shortest paths on the small graph of labels and splits."""

    def __init__(self) -> None:
        self.edges: list[list] = []  # [from, to, capacity left, cost]
        self.out: dict[object, list[int]] = defaultdict(list)

    def add(self, a: object, b: object, capacity: int, cost: int) -> int:
        at = len(self.edges)
        self.edges += [[a, b, capacity, cost], [b, a, 0, -cost]]
        self.out[a].append(at)
        self.out[b].append(at + 1)
        return at

    def run(self, source: object, sink: object) -> None:
        while True:
            dist, via, queue = {source: 0}, {}, [source]
            while queue:
                nxt = []
                for a in queue:
                    for e in self.out[a]:
                        _, b, left, cost = self.edges[e]
                        if left > 0 and dist[a] + cost < dist.get(b, BIG):
                            dist[b], via[b] = dist[a] + cost, e
                            nxt.append(b)
                queue = list(dict.fromkeys(nxt))
            if sink not in dist:
                return
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.edges[via[b]][0]
            push = min(self.edges[e][2] for e in path)
            for e in path:
                self.edges[e][2] -= push
                self.edges[e ^ 1][2] += push


def allocate(
    bundles: list[tuple[str, str, int, int, int]], quotas: dict[str, int], aim: dict[tuple[str, str], float] | None = None
) -> dict[tuple[str, str], dict[str, int]]:
    """Components of each bundle per split; ``aim`` replaces the records wanted per label and smaller split.

    ``bundles``: (label, class, records of a component, components, records).  A component larger than one
    and a half times what a split may hold of its label, or than the split's quota, must go to the largest
    split.  Costs: a record beyond a label's quota in a split 1, beyond the split's overall quota 4.
    """
    main = max(quotas, key=lambda s: quotas[s])
    rest = [s for s in quotas if s != main]
    share = sum(quotas.values())
    per_label: dict[str, int] = defaultdict(int)
    for b in bundles:
        per_label[b[0]] += b[4]
    quota = {(lb, s): round(n * quotas[s] / share) for lb, n in per_label.items() for s in quotas}
    if aim is not None:
        quota |= {(lb, s): round(aim.get((lb, s), 0)) for lb in per_label for s in rest}
        quota |= {(lb, main): max(0, n - sum(quota[lb, s] for s in rest)) for lb, n in per_label.items()}
    wanted = {s: sum(quota[lb, s] for lb in per_label) for s in quotas}

    def free(b: tuple) -> bool:
        return all(b[2] <= max(1, 1.5 * quota[b[0], s]) and b[2] <= max(1, wanted[s]) for s in rest)

    flow, supply = Flow(), defaultdict(int)
    for b in bundles:
        supply[b[0], free(b)] += b[4]
    for (lb, ok), n in sorted(supply.items()):
        flow.add("source", ("supply", lb, ok), n, 0)
        for s in quotas if ok else [main]:
            flow.add(("supply", lb, ok), ("label", lb, s), BIG, 0)
    for (lb, s), q in sorted(quota.items()):
        flow.add(("label", lb, s), ("split", s), q, 0)
        flow.add(("label", lb, s), ("split", s), BIG, 1)
    for s in quotas:
        flow.add(("split", s), "sink", wanted[s], 0)
        flow.add(("split", s), "sink", BIG, 4)
    flow.run("source", "sink")
    sent: dict[tuple[str, bool, str], int] = {}
    for e in range(0, len(flow.edges), 2):
        a, b = flow.edges[e][0], flow.edges[e][1]
        if a[0] == "supply":
            sent[a[1], a[2], b[2]] = flow.edges[e ^ 1][2]
    plan = {}
    carry: dict[str, float] = defaultdict(float)  # what rounding still owes each split, over all labels
    for lb in sorted(per_label, key=lambda x: (-per_label[x], x)):
        owed = {s: carry[s] * 0.5 for s in rest}
        mine = [b for b in bundles if b[0] == lb]
        carried = dict(owed)
        for b in sorted(mine, key=lambda x: (-x[2], x[1])):
            take = {s: 0 for s in quotas}
            left = b[3]
            if free(b):
                for s in rest:
                    owed[s] += b[4] * sent.get((lb, True, s), 0) / supply[lb, True]
                for s in sorted(rest, key=lambda x: -owed[x]):
                    k = min(left, max(0, int(owed[s] / max(1e-9, b[4] / b[3]) + 0.5)))
                    take[s] = k
                    left -= k
                    owed[s] -= k * b[4] / b[3]
            take[main] = left
            plan[b[0], b[1]] = take
        for s in rest:
            carry[s] += owed[s] - carried[s]
    return plan


def assign(fams: DataFrame, label_col: str, quotas: dict[str, int] = QUOTAS, given: str | None = None) -> DataFrame:
    """``doc, family, label, split, torn``: one split per family, near the quotas overall and within each label.

    ``torn`` tells whether the family had records in two or more splits of the column ``given`` before.
    """
    before = F.lower(F.trim(F.col(given))) if given else F.lit(None).cast("string")
    label = F.coalesce(F.col(label_col).cast("string"), F.lit("?"))
    fams = fams.select("doc", "family", label.alias("label"), F.when(before.isin(*quotas), before).alias("was"))
    fams = fams.withColumn("unit", F.coalesce(F.concat(F.lit("f:"), "family"), F.concat(F.lit("d:"), F.col("doc").cast("string"))))
    per = durable(fams.groupBy("unit", "label").agg(F.count("*").alias("c"), F.min("was").alias("lo"), F.max("was").alias("hi")), "split-labels")
    units = per.groupBy("unit").agg(F.sum("c").alias("n"), F.max_by("label", F.struct("c", "label")).alias("main_label"), F.count("*").alias("labels"), F.coalesce(F.min("lo") < F.max("hi"), F.lit(False)).alias("torn"))
    units = durable(units, "split-units")
    total = units.agg(F.sum("n")).first()[0]
    names = list(quotas)
    if not total:
        return fams.select("doc", "family", "label", F.lit(None).cast("string").alias("split"), F.lit(False).alias("torn"))
    size_class = F.concat(F.lit("="), F.col("n").cast("string"))
    units = units.withColumn("cls", F.concat(size_class, F.when(F.col("labels") > 1, "+").otherwise("")))  # single records have one label
    rows = units.groupBy("main_label", "cls").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()
    labels = {r["label"]: r["n"] for r in per.groupBy("label").agg(F.sum("c").alias("n")).collect()}
    main = max(quotas, key=lambda s: quotas[s])
    rest = [s for s in names if s != main]
    share = sum(quotas.values())
    quota = {(lb, s): n * quotas[s] / share for lb, n in labels.items() for s in rest}
    # single records come last and close what the families leave open in each language: a part of the quotas
    # is kept for them, as far as there are enough
    singles = {r["main_label"]: r["k"] for r in rows if r["cls"] == SINGLE}
    kept = {(lb, s): min(q, RESERVE * singles.get(lb, 0)) for (lb, s), q in quota.items()}
    bundles = [(r["main_label"], r["cls"], -(-r["n"] // r["k"]), r["k"], r["n"]) for r in rows if r["cls"] != SINGLE]
    mixed = per.join(units.where(F.col("cls") != SINGLE).select("unit", "main_label", "cls"), "unit").groupBy("main_label", "cls", "label").agg(F.sum("c").alias("n")).collect()
    plan = _refined(bundles, {(r["main_label"], r["cls"], r["label"]): r["n"] for r in mixed}, quotas, {k: q - kept[k] for k, q in quota.items()})
    first = durable(_by_rank(units.where(F.col("cls") != SINGLE), plan, rest, main), "split-families")
    have = {(r["label"], r["split"]): r["n"] for r in per.join(first.select("unit", "split"), "unit").groupBy("label", "split").agg(F.sum("c").alias("n")).collect()}
    last = {}
    for lb, k in singles.items():
        open_ = {s: max(0.0, quota[lb, s] - have.get((lb, s), 0)) for s in rest}
        scale = min(1.0, k / (sum(open_.values()) or 1.0))
        take = {s: int(x * scale + 0.5) for s, x in open_.items()}
        take[rest[-1]] = min(take[rest[-1]], k - sum(take[s] for s in rest[:-1]))
        last[lb, SINGLE] = take | {main: k - sum(take.values())}
    chosen = first.union(_by_rank(units.where(F.col("cls") == SINGLE), last, rest, main))
    return salted_join(fams, durable(chosen, "split-units-chosen"), "unit", "n", total=total).select("doc", "family", "label", "split", "torn")


def _refined(bundles: list[tuple], mixed: dict[tuple[str, str, str], int], quotas: dict[str, int], want: dict[tuple[str, str], float], rounds: int = 12) -> dict:
    """The best of some allocations, each aiming off by what the one before is expected to miss.

    ``mixed`` has the records per bundle and label: families led by one language bring others along.
    """
    k = {(b[0], b[1]): b[3] for b in bundles}
    aim, best = dict(want), (float("inf"), {})
    for _ in range(rounds):
        plan = allocate(bundles, quotas, aim)
        got: dict[tuple[str, str], float] = defaultdict(float)
        for (lb, cl, label), n in mixed.items():
            for s, take in plan[lb, cl].items():
                got[label, s] += n * take / k[lb, cl]
        miss = sum(abs(w - got[key]) for key, w in want.items())
        best = min(best, (miss, plan), key=lambda x: x[0])
        aim = {key: max(0.0, aim[key] + 0.7 * (w - got[key])) for key, w in want.items()}
    return best[1]


def _by_rank(units: DataFrame, plan: dict[tuple[str, str], dict[str, int]], rest: list[str], main: str) -> DataFrame:
    """``unit, n, split``: the members of each bundle told apart by the rank of their hash."""
    spark = units.sparkSession
    cuts = [(lb, cl, *[sum(t[s] for s in rest[: i + 1]) for i in range(len(rest))]) for (lb, cl), t in plan.items()]
    schema = "main_label string, cls string, " + ", ".join(f"cut{i} long" for i in range(len(rest)))
    ranked = running_sum(units.withColumn("h", F.xxhash64("unit")).withColumn("one", F.lit(1)), ["main_label", "cls"], "h", ["unit"], {"rank": "one"})
    ranked = ranked.join(F.broadcast(spark.createDataFrame(cuts, schema)), ["main_label", "cls"])
    split = F.lit(main)
    for i in reversed(range(len(rest))):
        split = F.when(F.col("rank") < F.col(f"cut{i}"), F.lit(rest[i])).otherwise(split)
    return ranked.select("unit", "n", split.alias("split"), "torn")
