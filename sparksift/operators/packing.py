"""Packing ranked sections into a budget of bytes and lines (a separator of two bytes and a line after the first), and rendering them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparksift.session import checkpointed

SEPARATOR = (2, 1)
RESERVE = (96, 3)  # bytes and lines kept free around a partial section
LEAST_PARTIAL = 32
#: Words that may mark a block's end.
WORDS = ("AMBER", "BRINE", "COBALT", "DRIFT", "EMBER", "FLINT", "GROVE", "HAZEL", "INLET", "KELP", "LARCH", "MOSS", "OCHRE", "PEAT", "QUARTZ", "REED")


def running(items: DataFrame, *order: str) -> DataFrame:
    """Bytes and lines used up to each item.

    Running sums are taken within ranges of the order and then over the ranges, so no task sees all rows.
    """
    sorted_ = checkpointed(items.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lead = sorted_.agg(F.min("__part")).first()[0]
    first = (F.col("__part") == F.lit(lead).cast("int")) & (F.row_number().over(within) == 1)
    sized = sorted_.withColumn("__b", F.col("bytes") + F.when(first, 0).otherwise(SEPARATOR[0])).withColumn("__l", F.col("n_lines") + F.when(first, 0).otherwise(SEPARATOR[1]))
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = sized.groupBy("__part").agg(F.sum("__b").alias("__sb"), F.sum("__l").alias("__sl"))
    before = parts.select("__part", F.sum("__sb").over(over).alias("__bb"), F.sum("__sl").over(over).alias("__bl"))
    out = sized.withColumn("__ib", F.sum("__b").over(within)).withColumn("__il", F.sum("__l").over(within)).join(F.broadcast(before), "__part")
    total = lambda inner, earlier: F.coalesce(F.col(inner) + F.col(earlier), F.col(inner), F.col(earlier)).cast("long")
    return out.withColumn("used_bytes", total("__ib", "__bb")).withColumn("used_lines", total("__il", "__bl")).drop("__part", "__b", "__l", "__ib", "__il", "__bb", "__bl")


def prefix(items: DataFrame, order: str, max_bytes: int, max_lines: int) -> DataFrame:
    """The items before the first that does not fit (what is used never falls, so all after it are over too)."""
    over = (F.col("used_bytes") > max_bytes) | (F.col("used_lines") > max_lines)
    return running(items, order).where(~F.coalesce(over, F.lit(False)))


def skip(items: DataFrame, order: list[str], key: str, max_bytes: int, max_lines: int) -> DataFrame:
    """The items taken in order where what does not fit is passed over.

    Each round folds the next items that fit what room is left by themselves; a separator takes a line, so at most
    ``max_lines`` + 1 items are ever taken, and each round but the last takes one or more.
    """
    spark, kind = items.sparkSession, items.schema[key].dataType.simpleString()
    place = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate([*order, key, "bytes", "n_lines"])))
    rows_ = items.select(place.alias("p"), F.col(key).alias("k"), F.col("bytes").alias("b"), F.col("n_lines").alias("l"))
    most, used, taken, last = max(4096, max_lines + 2), (0, 0), [], None
    while True:
        sep = SEPARATOR if taken else (0, 0)
        fits = (F.col("b") <= max_bytes - used[0] - sep[0]) & (F.col("l") <= max_lines - used[1] - sep[1])
        left = rows_.where(fits)
        if last is not None:
            left = left.where(F.col("p") > F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, rows_.schema["p"].dataType.fields, strict=True))))
        rows = left.orderBy("p").limit(most).collect()
        full = len(rows) == most
        if full and rows[0].p != rows[-1].p:  # equal rows at the end come with the next round
            rows = [r for r in rows if r.p != rows[-1].p]
        for r in rows:
            after = _with(used, (r.b, r.l), bool(taken))
            if after[0] <= max_bytes and after[1] <= max_lines:
                used = after
                taken.append((r.k,))
        if not full:
            return spark.createDataFrame(taken, f"`{key}` {kind}")
        last = rows[-1].p


@dataclass
class Section:
    """A file's section: its place in the request, path, rendered text, and whether it was read."""

    index: int
    path: str
    text: str
    ok: bool = True

    @property
    def size(self) -> tuple[int, int]:
        return len(self.text.encode()), self.text.count("\n") + 1 if self.text else 0


@dataclass
class Plan:
    strategy: str
    full: list[int] = field(default_factory=list)
    partial: Section | None = None
    omitted: list[int] = field(default_factory=list)
    used: tuple[int, int] = (0, 0)
    successes: int = 0


def _with(used: tuple[int, int], size: tuple[int, int], some: bool) -> tuple[int, int]:
    return used[0] + size[0] + SEPARATOR[0] * some, used[1] + size[1] + SEPARATOR[1] * some


def partial(section: Section, free: tuple[int, int]) -> Section | None:
    """The head of a section, cut at line ends, that fits what is free less a reserve."""
    room, lines = free[0] - RESERVE[0], free[1] - RESERVE[1]
    if room < LEAST_PARTIAL or lines < 1:
        return None
    kept, size = [], 0
    for line in section.text.split("\n")[:lines]:
        size += len(line.encode()) + 1
        if size > room:
            break
        kept.append(line)
    if not kept or sum(len(x.encode()) + 1 for x in kept) < LEAST_PARTIAL:
        return None
    return Section(section.index, section.path, "\n".join([*kept, f"[{len(kept)} lines shown]"]), section.ok)


def plan(sections: list[Section], order: list[int], strategy: str, max_bytes: int, max_lines: int) -> Plan:
    """Sections taken in an order: request-order stops at the first that does not fit, others pass it over; then a part of the first one left out."""
    out, at = Plan(strategy), {s.index: s for s in sections}
    for i in order:
        after = _with(out.used, at[i].size, bool(out.full))
        if after[0] <= max_bytes and after[1] <= max_lines:
            out.full.append(i)
            out.used = after
            out.successes += at[i].ok
        elif strategy == "request-order":
            break
    left = [s for s in sorted(sections, key=lambda s: s.index) if s.index not in out.full]
    for s in left:
        used = _with(out.used, (0, 0), bool(out.full))
        if s.ok and (cut := partial(s, (max_bytes - used[0], max_lines - used[1]))):
            out.partial, out.used = cut, _with(out.used, cut.size, bool(out.full))
            break
    out.omitted = [s.index for s in left if not out.partial or s.index != out.partial.index]
    return out


def plans(sections: list[Section], relevance: list[int], max_bytes: int, max_lines: int) -> dict[str, Plan]:
    """The three strategies' plans for a request."""
    orders = {"request-order": [s.index for s in sections], "smallest-first": [s.index for s in sorted(sections, key=lambda s: (s.size[0], s.index))], "relevance-first": relevance}
    return {k: plan(sections, o, k, max_bytes, max_lines) for k, o in orders.items()}


def choose_intent(found: dict[str, Plan], best: int) -> Plan:
    """Most sections read, then one that holds the best-ranked, then request, smallest, relevance."""
    order = ("request-order", "smallest-first", "relevance-first")
    return min((found[k] for k in order), key=lambda p: (-p.successes, best not in p.full, order.index(p.strategy)))


def choose_many(found: dict[str, Plan]) -> Plan:
    """Relevance only if it reads more than both others; smallest only if more than request order."""
    r, s, v = (found[k] for k in ("request-order", "smallest-first", "relevance-first"))
    if v.successes > max(r.successes, s.successes):
        return v
    return s if s.successes > r.successes else r


def relevance(path: str, depth: int, ok: bool = True) -> float:
    """How much a file among many is worth reading: source folders up, tests, configuration and builds down, depth up to 2."""
    if not ok:
        return -1.0
    p = path.lower()
    score = 2.0 + min(2.0, 0.25 * depth)
    score += 1.0 * any(f"/{d}/" in f"/{p}" for d in ("src", "lib", "app")) + 0.5 * p.endswith((".ts", ".tsx", ".js", ".py", ".go", ".rs"))
    return score - 1.0 * ("test" in p or "spec" in p) - 0.5 * p.endswith((".json", ".yml", ".yaml", ".toml", ".lock")) - 1.0 * any(f"/{d}/" in f"/{p}" for d in ("dist", "build", "out"))


def delimiter(index: int, text: str) -> str:
    """A word that is no line of the text; a numbered suffix where it is."""
    word = WORDS[index - 1] if 0 < index <= len(WORDS) else f"FILE{index}"
    lines = set(text.split("\n"))
    return next(w for w in (word, *(f"{word}_{i}" for i in range(1, len(lines) + 2))) if w not in lines)


def heredoc(sections: list[tuple[int, str, str]], first: int = 1) -> str:
    """Blocks of (index, path, body): the path, the body's numbered lines between marks; blocks joined by an empty line."""
    out = []
    for index, path, body in sections:
        numbered = "\n".join(f"{i}|{line}" for i, line in enumerate(body.split("\n"), first))
        mark = delimiter(index, numbered)
        out.append(f"@{path}\n<<'{mark}'\n{numbered}\n{mark}")
    return "\n\n".join(out)
