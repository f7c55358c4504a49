"""Fill-in-the-middle rewriting by sparse events of one Aho-Corasick automaton.

A text is cut into units: a run of characters that are no ASCII white space with the white space before it, and white
space at the end of the text as one more. The automaton knows the six white-space characters, the only ones at which
the class changes, and the sentinels. Its events are sparse; everything between two of them is one run. So a gap of any
length counts one unit, the units of a text are counted from the gaps, and the k-th unit ends where the k-th gap
does: two look-ups in the array of gaps give the cuts, and no text is split into tokens.

The cuts come from the SHA-256 of a seed and the row's id, so a row gives the same output whenever and wherever it is
made again. A text with a sentinel of its own stays plain, which is why an output can always be taken apart.

Defined results: a null text is empty; an empty text has no units and stays plain; a null id draws as an empty one;
repeated rows draw alike; texts of any length are held as events, nine bytes each; an empty table gives an empty one.
Columns not asked for are ignored, whatever they are called.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_docs, schema_of

#: The characters between units, and the marks before prefix, suffix and middle.
SPACES = " \t\n\v\f\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are rewritten, and of a hundred of these so many begin with the suffix.
REWRITTEN, SUFFIX_FIRST = 50, 80
_EVENT = np.dtype([("at", "i8"), ("mark", "i1")])


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """One automaton for white space (0) and sentinels (1)."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for word, kind in [*((c, 0) for c in SPACES), *((s, 1) for s in (PREFIX, SUFFIX, MIDDLE))]:
        out.add_word(word, kind)
    out.make_automaton()
    return out


class Units:
    """The units of a text, known by its events alone."""

    def __init__(self, text: str):
        events = np.fromiter(automaton().iter(text), _EVENT) if text else np.empty(0, _EVENT)
        self.marked = bool(events["mark"].any())
        edges = np.concatenate(([-1], events["at"][events["mark"] == 0], [len(text)]))
        ends = edges[1:][np.diff(edges) > 1]  # where each gap ends
        #: Exclusive end of each unit.
        self.ends = np.append(ends, len(text)) if text and (not len(ends) or ends[-1] < len(text)) else ends

    def __len__(self) -> int:
        return len(self.ends)

    def end(self, k: int) -> int:
        """Code points of the first ``k`` units."""
        return int(self.ends[k - 1]) if k else 0


def arranged(text: str, low: int, high: int, form: str) -> str:
    """``text`` with its middle from ``low`` to ``high`` put last, as ``form`` says."""
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if form == "plain":
        return text
    head = f"{PREFIX}{prefix}{SUFFIX}{suffix}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}"
    return f"{head}{MIDDLE}{middle}"


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits for a row's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def rewrite(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rewritten: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; a narrow map.

    ``n`` counts the text's units. ``form`` is ``plain``, ``psm`` (prefix, suffix, middle) or ``spm`` (suffix first);
    the character counts are null where it is plain. The id keeps its name and type.
    """

    def run(ids, texts, *numbers):
        rows = []
        for text, h1, h2, h3, h4 in zip(texts, *numbers):
            text = text or ""
            units = Units(text)
            n = len(units)
            if not text or units.marked or h3 % 100 >= rewritten:
                rows.append((n, "plain", None, None, text))
                continue
            low, high = (units.end(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            form = "spm" if h4 % 100 < suffix_first else "psm"
            rows.append((n, form, low, high - low, arranged(text, low, high, form)))
        return {id_col: ids} | {name: [r[i] for r in rows] for i, name in enumerate(("n", "form", "prefix_chars", "middle_chars", "output"))}

    kept = docs.select(id_col).schema.fields
    made = schema_of("n long, form string, prefix_chars long, middle_chars long, output string").fields
    if id_col in {f.name for f in made}:
        raise ValueError(f"an id cannot be called {id_col}")
    return map_docs(docs, [id_col, text_col, *draws(id_col, seed)], run, type(docs.schema)([*kept, *made]))


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    body = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)

    def parts(second):
        return F.substring(F.substring_index(body, second, 1), 1 + len(PREFIX), 2**31 - 1), F.substring_index(body, second, -1)

    (prefix, suffix), (late_suffix, late_prefix) = parts(SUFFIX), parts(PREFIX)
    psm, spm = F.concat(prefix, middle, suffix), F.concat(late_prefix, middle, late_suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
