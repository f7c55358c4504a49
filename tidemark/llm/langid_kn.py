"""Language identification by interpolated Kneser-Ney character language models.

Training counts all character 4-grams of all training rows: each task adds up its own share, Spark
sums the shares by (language, 4-gram). Lower orders use continuation counts, which follow from the
distinct higher-order types. N-grams are kept exactly, packed in a long, so no two share a count and what
was never seen has none. A model has, for each language and order, the sorted n-grams with their discounted
counts (12 bytes each) and the sorted contexts (16 bytes each). It grows with the distinct n-grams of the corpus,
not with its rows: all counts are a table in the shared folder, of which languages up to GROUP_ENTRIES n-grams
in all are gathered by the driver and sent to the tasks at once. More languages take more passes over the
texts, each of which carries on the lowest cross-entropies, and a language that is larger by itself is cut into
shards with a pass for each: by the character before the last of an n-gram, which is the last one of its
context, so all that a 4-gram asks for but the unigrams is in one shard, and the shards' shares of a
cross-entropy add up. Results do not depend on the number of passes.

A text is scored by its cross-entropy per character under every language; the lowest wins. The
confidence is a calibrated logistic of how far the text lies from the winner's own training texts.

Text is lower-cased; every run of characters that are not letters becomes one space. Symbols are UTF-16 units, so
a letter beyond the first plane is two of them.

Defined results: null or letterless text is ``und`` with score 0; ties go to the alphabetically first
language; rows without a language do not train; without any training row everything is ``und``;
repeated rows give one row each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_map, map_docs, saved, schema_of, slices

ORDER = 4
#: Symbols have 16 bits each, so a 4-gram is one long.
_CHAR = 16
#: N-grams and contexts that are gathered and sent at once, some 14 bytes each.
GROUP_ENTRIES = 8_000_000
#: Languages that a model may have. No labelled corpus has as many; a column of something else ends with an error.
MOST_LANGS = 10_000
UND = "und"
#: Steps of a nat in which the cross-entropies of training rows are counted to calibrate the rejection.
CALIBRATION_STEPS = 1_000
#: Texts whose score is lower are rejected.
REJECT = 0.02

_NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def symbols(text: str | None) -> np.ndarray:
    """Folded characters, with a space at either end; empty without a letter."""
    plain = _NOT_LETTER.sub(" ", text.lower()).strip() if text else ""
    if not plain or not _LETTER.search(plain):
        return np.zeros(0, np.uint64)
    return np.frombuffer(f" {plain} ".encode("utf-16-le"), "<u2").astype(np.uint64)


def grams(sym: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams, the last character in the lowest bits."""
    n = len(sym) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return reduce(lambda acc, k: acc << np.uint64(_CHAR) | sym[k : k + n], range(1, order), sym[:n].copy())


def slot(packed: np.ndarray) -> np.ndarray:
    """Key of packed n-grams in a model: the n-gram itself, as a signed long."""
    return packed.view(np.int64)


def shard_of(character, shards: int):
    """The shard of an n-gram by its character before the last: of numbers or of a column."""
    return character * 40_503 % 65_521 % shards


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) of every 4-gram in all rows; each task sends each of its 4-grams once."""
    schema = schema_of("lang string, gram long, n long")
    arrow = to_arrow_schema(schema)

    def rows(held):
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], schema=arrow
            )

    def merge(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, counts, len(keys)).astype(np.int64)

    def run(batches):
        held: dict = {}
        for part in slices(batches):
            found: dict = {}
            for text, lang in zip(*(c.to_pylist() for c in part.columns)):
                found.setdefault(lang, []).append(grams(symbols(text), ORDER))
            for lang, lists in found.items():
                new = np.unique(np.concatenate(lists), return_counts=True)
                held[lang] = merge([held[lang], new]) if lang in held else new
            if sum(len(k) for k, _ in held.values()) > 2_000_000:
                yield from rows(held)
                held = {}
        yield from rows(held)

    share = arrow_map(docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col), run, schema)
    return share.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def folded_counts(counts: DataFrame) -> DataFrame:
    """(lang, ord, kind, slot, n, types, once, twice): of n-grams (kind true) and of their contexts."""
    schema = schema_of("lang string, ord int, kind boolean, slot long, n long")
    arrow = to_arrow_schema(schema)

    def slots(order):
        def run(batches):
            for b in batches:
                packed = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for kind, cut in ((True, packed), (False, packed >> np.uint64(_CHAR))):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(np.full(len(cut), order, np.int32)), pa.array(np.full(len(cut), kind)),
                         pa.array(slot(cut)), b.column(2)],
                        schema=arrow,
                    )

        return run

    parts, types = [], counts
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            kept = F.col("gram").bitwiseAND((1 << (_CHAR * order)) - 1)
            types = types.groupBy("lang", kept.alias("gram")).agg(F.count("*").alias("n"))
        parts.append(arrow_map(types.select("lang", "gram", "n"), slots(order), schema))
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("lang", "ord", "kind", "slot")
        .agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
    )


class Model:
    """Counts of every language in sorted n-gram arrays, one for each order, and probabilities made of them."""

    def __init__(self, langs: list[str], table: dict[str, np.ndarray], ones: dict[tuple[str, int], tuple[int, int]]):
        """``table`` has lang (a place in ``langs``), ord, kind, slot, n and types of folded_counts; ``ones``
        how many n-grams of a language and order were counted once and twice."""
        self.langs = langs
        self.grams, self.contexts = {}, {}
        for order in range(1, ORDER + 1):
            for k, lang in enumerate(langs):
                of = (table["ord"] == order) & (table["lang"] == k)
                once, twice = ones.get((lang, order), (0, 0))
                discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
                keys, n, _ = self._sorted(table, of & table["kind"])
                ckeys, total, kinds = self._sorted(table, of & ~table["kind"])
                # what is not found has place -1: no count, and all weight for the lower order
                self.grams[order, k] = keys, np.append(np.maximum(n - discount, 0), 0).astype(np.float32)
                back = np.append(discount * kinds / np.maximum(total, 1), 1).astype(np.float32)
                self.contexts[order, k] = ckeys, np.append(total, 0).astype(np.float32), back

    def _sorted(self, table, of):
        keys = table["slot"][of]
        by = np.argsort(keys)
        return keys[by], table["n"][of][by].astype(float), table["types"][of][by].astype(float)

    def _find(self, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)

    def probability(self, packed: np.ndarray, order: int, of: list[int] | None = None) -> np.ndarray:
        """P(last character | the characters before) of packed n-grams, a column for each language, or those in ``of``."""
        of = range(len(self.langs)) if of is None else of
        if order == 0:
            return np.full((len(packed), len(of)), 1.0 / (1 << _CHAR))
        out = self.probability(packed & np.uint64((1 << (_CHAR * (order - 1))) - 1), order - 1, of)
        wanted, before = slot(packed), slot(packed >> np.uint64(_CHAR))
        for col, k in enumerate(of):
            keys, count = self.grams[order, k]
            ckeys, total, back = self.contexts[order, k]
            ctx = self._find(ckeys, before)
            out[:, col] = count[self._find(keys, wanted)] / np.maximum(total[ctx], 1.0) + back[ctx] * out[:, col]
        return out

    def cross_entropies(self, texts: list[np.ndarray], of: list[int] | None = None, shard: int = 0, shards: int = 1) -> np.ndarray:
        """A row for each text, a column for each language or those in ``of``; equal 4-grams of all texts are looked up
        once. Of several shards, the share that the n-grams of ``shard`` have in the cross-entropy."""
        packed = [grams(s, min(ORDER, len(s))) for s in texts]
        out = np.zeros((len(texts), len(self.langs if of is None else of)))
        whole = [k for k, s in enumerate(texts) if len(s) >= ORDER]
        if whole:
            flat, at = np.unique(np.concatenate([packed[k] for k in whole]), return_inverse=True)
            logs = -np.log(self.probability(flat, ORDER, of)) * _within(flat, shard, shards)
            ends = np.cumsum([0] + [len(packed[k]) for k in whole])
            for k, a, b in zip(whole, ends, ends[1:]):
                out[k] = logs[at[a:b]].sum(axis=0) / (b - a)
        for k, s in enumerate(texts):
            if 0 < len(s) < ORDER:
                out[k] = (-np.log(self.probability(packed[k], len(s), of)) * _within(packed[k], shard, shards))[0]
        return out


def _within(packed: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """A column of one where an n-gram is the shard's, of zero elsewhere."""
    before = (packed >> np.uint64(_CHAR)).astype(np.int64) & ((1 << _CHAR) - 1)
    return (shard_of(before, shards) == shard)[:, None].astype(float)


def _quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """Of sorted values with their counts, between ranks as numpy's percentile."""
    ends = np.cumsum(counts)
    rank = q * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, r, side="right")] for r in (np.floor(rank), np.ceil(rank)))
    return float(low + (high - low) * (rank % 1))


class Group(NamedTuple):
    """Languages that are gathered at once, or one shard of a large language."""

    langs: list[str]
    shard: int = 0
    shards: int = 1


class Identifier:
    """Models of groups of languages with their calibration: per language the middle and spread of its own texts'
    cross-entropy. ``build`` makes the model of a group."""

    def __init__(self, groups: list[Group], build: Callable[[Group], Model]):
        self.groups, self._build = groups or [Group([])], build
        self.langs = [x for g in groups if not g.shard for x in g.langs]
        self._held: tuple[int, Model] | None = None
        self.mean, self.spread = np.zeros(len(self.langs)), np.ones(len(self.langs))

    @property
    def model(self) -> Model:
        return self.group(0)

    def group(self, k: int) -> Model:
        """The model of a group; the last one that was asked for is held."""
        if self._held is None or self._held[0] != k:
            self._held = k, self._build(self.groups[k])
        return self._held[1]

    def scorer(self, k: int) -> Scorer:
        first = self.langs.index(self.groups[k].langs[0]) if self.langs else 0
        return Scorer(self.group(k), self.groups[k], first, self.langs, self.mean, self.spread)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores of a few texts, by all groups in turn."""
        state = None
        for k in range(len(self.groups)):
            state = self.scorer(k).step(texts, state)
        return [r["lang"] for r in state], [r["score"] for r in state]


class Scorer:
    """One group of languages, and what is needed to name and score the best of all."""

    def __init__(self, model: Model, group: Group, first: int, langs: list[str], mean: np.ndarray, spread: np.ndarray):
        self.model, self.group, self.first, self.langs, self.mean, self.spread = model, group, first, langs, mean, spread

    def step(self, texts: list[str | None], before: list[dict] | None) -> list[dict]:
        """For each text the lowest and the second cross-entropy so far, whose the lowest is, and what follows."""
        syms = [symbols(t) for t in texts]
        out = before or [{"place": -1, "best": np.inf, "second": np.inf, "part": 0.0, "lang": UND, "score": 0.0} for _ in texts]
        have = [k for k, s in enumerate(syms) if len(s)]
        if not have or not self.model.langs:
            return out
        ce = self.model.cross_entropies([syms[k] for k in have], None, self.group.shard, self.group.shards)
        for k, row in zip(have, ce):
            held = out[k]
            row = row + held["part"]
            if self.group.shard + 1 < self.group.shards:
                held["part"] = float(row[0])
                continue
            order = np.argsort(row, kind="stable")[:2]
            place, best, second = held["place"], held["best"], held["second"]
            if row[order[0]] < best:  # ties go to the language before, groups are in alphabetical order
                place, second, best = self.first + int(order[0]), min(best, second), float(row[order[0]])
                second = min(second, float(row[order[1]])) if len(order) > 1 else second
            else:
                second = min(second, float(row[order[0]]))
            size = len(syms[k])
            # how much dearer than usual for the language, in its own spreads, allowing short texts more
            dear = (best - self.mean[place]) / (self.spread[place] * (1 + 4 / np.sqrt(size)))
            fit = 1 / (1 + np.exp(min(50.0, dear - 6)))
            lead = (second - best) * size if np.isfinite(second) else 50.0
            score = float(np.clip(fit * (1 - 0.5 * np.exp(-min(50.0, lead))), 0, 1))
            out[k] = {"place": place, "best": best, "second": second, "part": 0.0, "lang": self.langs[place], "score": score}
        return out


def _calibrated(found: Identifier, rows: DataFrame, text_col: str, lang_col: str) -> None:
    """Sets middle and spread of every language from the cross-entropies of all its training rows under it."""
    texts = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.lit(0.0).alias("ce"))
    part = texts
    for k, group in enumerate(found.groups if found.langs else []):
        shared = rows.sparkSession.sparkContext.broadcast(found.group(k))

        def own(texts, labels, before, shared=shared, group=group):
            """Adds to each text's cross-entropy under its own language; null without a letter or in another group."""
            model, out = shared.value, [None] * len(texts)
            places = {lang: k for k, lang in enumerate(model.langs)}
            by_lang: dict = {}
            for at, (text, label) in enumerate(zip(texts, labels)):
                if label in places and len(s := symbols(text)):
                    by_lang.setdefault(places[label], []).append((at, s))
            for k, mine in by_lang.items():
                ce = model.cross_entropies([s for _, s in mine], [k], group.shard, group.shards)[:, 0]
                for (at, _), x in zip(mine, ce.tolist()):
                    out[at] = before[at] + x
            # texts are wanted again by the next shard alone
            return {"text": [None] * len(texts) if group.shard + 1 == group.shards else texts, "lang": labels, "ce": out}

        part = part if group.shard else texts if len(found.groups) == 1 else texts.where(F.col("lang").isin(group.langs))
        part = map_docs(part, ["text", "lang", "ce"], own, "text string, lang string, ce double").where("ce is not null")
        if group.shard + 1 < group.shards:
            part = saved(part)
            continue
        cells = part.groupBy("lang", F.round(F.col("ce") * CALIBRATION_STEPS).cast("long").alias("step")).count().collect()
        for lang in group.langs:  # a few thousand cells a language
            mine = np.array(sorted((r["step"], r["count"]) for r in cells if r["lang"] == lang), np.int64).reshape(-1, 2)
            if len(mine):
                place = found.langs.index(lang)
                middle, high = (_quantile(mine[:, 0], mine[:, 1], q) / CALIBRATION_STEPS for q in (0.5, 0.95))
                found.mean[place], found.spread[place] = middle, max(0.1, high - middle)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", group_entries: int = GROUP_ENTRIES) -> Identifier:
    """Count all rows of ``train``, then calibrate the rejection on all of them."""
    folded = saved(folded_counts(saved(gram_counts(train, text_col, lang_col))))
    sums = (
        folded.groupBy("lang", "ord").agg(F.sum(F.when(F.col("kind"), F.col("once"))).alias("once"), F.sum(F.when(F.col("kind"), F.col("twice"))).alias("twice"), F.count("*").alias("entries"))
        .limit(MOST_LANGS * ORDER + 1).collect()
    )
    if len(sums) > MOST_LANGS * ORDER:
        raise ValueError(f"more than {MOST_LANGS} languages in {lang_col}")
    ones = {(r["lang"], r["ord"]): (r["once"], r["twice"]) for r in sums}
    groups: list[Group] = []
    held = group_entries
    for lang in sorted({r["lang"] for r in sums}):
        size = sum(r["entries"] for r in sums if r["lang"] == lang)
        if size > group_entries:
            shards = -(-size // group_entries)
            groups += [Group([lang], k, shards) for k in range(shards)]
            held = group_entries  # what comes next begins a group
        elif held + size > group_entries:
            groups.append(Group([lang]))
            held = size
        else:
            groups[-1].langs.append(lang)
            held += size

    def build(group: Group) -> Model:
        place = F.array_position(F.array(*map(F.lit, group.langs)) if group.langs else F.array(F.lit("")), F.col("lang")) - 1
        rows = folded.where(F.col("lang").isin(group.langs)) if len(groups) > 1 else folded
        if group.shards > 1:
            slot_ = F.col("slot")
            before = F.when(F.col("kind"), F.shiftrightunsigned(slot_, _CHAR)).otherwise(slot_).bitwiseAND((1 << _CHAR) - 1)
            rows = rows.where((F.col("ord") == 1) | (shard_of(before, group.shards) == group.shard))
        small = rows.select(place.cast("smallint").alias("lang"), F.col("ord").cast("tinyint"), "kind", "slot", F.col("n").cast("float"), F.col("types").cast("int")).toArrow()
        return Model(group.langs, {n: small.column(n).to_numpy(zero_copy_only=False) for n in small.column_names}, ones)

    found = Identifier(groups, build)
    _calibrated(found, train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), text_col, lang_col)
    return found


STATE = "struct<place: int, best: double, second: double, part: double, lang: string, score: double>"


def _told(rows: DataFrame, text_at: int, model: Identifier, texts: bool = True) -> tuple[DataFrame, str]:
    """``rows``, without their texts if ``texts`` is false, with a last column of STATE, and its name: a pass for
    each group of languages."""
    spark, width, name = rows.sparkSession, len(rows.columns), "told"
    while name in rows.columns:
        name += "_"
    fields, passes = rows.schema.fields, len(model.groups)
    for k in range(passes):
        shared = spark.sparkContext.broadcast(model.scorer(k))
        kept = [c for c in range(width) if texts or c != text_at or k + 1 < passes]
        schema = StructType([*(fields[c] for c in kept), *schema_of(f"{name} {STATE}").fields])
        arrow = to_arrow_schema(schema)

        def run(batches, shared=shared, first=k == 0, kept=kept, arrow=arrow):
            for part in slices(batches):
                before = None if first else part.column(width).to_pylist()
                state = shared.value.step(part.column(text_at).to_pylist(), before)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(state, arrow[len(kept)].type)], names=arrow.names)

        rows = arrow_map(saved(rows) if k else rows, run, schema)
    return rows, name


def identify(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    out, told = _told(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), 1, model, texts=False)
    return out.select("doc_id", F.col(f"{told}.lang").alias("lang_pred"), f"{told}.score")


def accepted(docs: DataFrame, model: Identifier, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """Rows whose language is told with a score of ``reject`` or more, all columns kept."""
    out, told = _told(docs, docs.columns.index(text_col), model)
    return out.where((F.col(f"{told}.lang") != UND) & (F.col(f"{told}.score") >= reject)).select(docs.columns)
