"""Dictionary matching: which of any number of terms a text names as whole words, in one pass over its words.

A text's words are looked up in one hashed set, and so are the stretches of two words and more that begin with the
first word of a longer term; what stands between their words counts as it is written. The cost of a text is that of
its words, however many terms the dictionary has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text, word_pattern, words

#: A word: letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def whole_words(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(col)), F.lit(WORD), F.lit(0))


def found(col: Column, terms: Iterable[str], said: Column | None = None) -> Column:
    """array<string>: the distinct lower-case terms that occur in the text as whole words, case aside. Terms that begin
    or end with something else than a word's character (c++) are looked for one by one. ``said``: ``whole_words`` of the
    text, where that is a column already."""
    known = sorted({t.lower() for t in terms if t})
    inside = {t: re.findall(r"\w+", t) for t in known}
    odd = [t for t in known if not inside[t] or not t.startswith(inside[t][0]) or not t.endswith(inside[t][-1])]
    single = [t for t in known if inside[t] == [t]]
    several = [t for t in known if t not in set(odd) and len(inside[t]) > 1]
    low = F.lower(text(col))

    def look(said: Column) -> Column:
        hits = [F.filter(said, lambda t: t.isin(single))] if single else []
        if several:
            first, sizes = sorted({inside[t][0] for t in several}), sorted({len(inside[t]) for t in several})

            def longer(between: Column) -> Column:
                part = lambda i, k: F.concat(F.get(between, i + k), F.get(said, i + k))
                stretch = lambda i, n: F.concat(F.get(said, i), *[part(i, k) for k in range(1, n)])
                begin = F.filter(F.sequence(F.lit(0), F.size(said) - 1), lambda i: F.get(said, i).isin(first))
                return F.flatten(F.transform(begin, lambda i: F.filter(F.array(*[stretch(i, n) for n in sizes]), lambda t: t.isin(several))))

            # what stands between the words is cut out only of texts that say the first word of a longer term
            hits.append(F.when(F.exists(said, lambda t: t.isin(first)), let(F.split(low, WORD, -1), longer)).otherwise(words([])))
        hits += [F.when(low.rlike(word_pattern([t])), words([t])).otherwise(words([])) for t in odd]
        return F.array_distinct(F.concat(*hits)) if hits else words([])

    return let(whole_words(col), look) if said is None else look(said)
