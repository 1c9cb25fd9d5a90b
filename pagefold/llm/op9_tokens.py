"""Token counts with a prefix table (operator 9).

Before a blank that follows or precedes a visible character, the byte-level
rule always starts a new pre-token, and a byte-level BPE never merges across
pre-tokens.  So a text falls into pieces, each a blank and what follows it, and
dynamic programming along them works out, once per text,

* ``ends[i]``  -- code points up to the end of piece ``i``,
* ``total[i]`` -- tokens up to there: ``total[i-1] + cost(piece i)``.

``count_at`` and ``cut`` answer "how many tokens has this prefix" and "the
longest prefix within a budget" by binary search in these two lists; only the
piece under the cut is looked at again.  A text's token count is the table's last
entry.  ``cost`` is asked of the tokenizer library once per piece and kept in a
table of bounded size.

The string of an added token is a piece of one token; the library reads the
stretches between such strings one by one, and so does the table.  A stretch with
a blank between two other white-space characters falls into pieces less simply:
its pieces are the library's pre-tokens.

Cases: a null text counts as empty (0 bytes, 0 tokens); null ids and repeated
rows give one result row per input row; extra columns are ignored; an empty
table gives an empty result.  There is no limit on the length of a text.
"""

from __future__ import annotations

import bisect
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagefold.llm.common import arrow_map, held, read
from pagefold.plans.catalog import register

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Distinct pieces whose counts one worker keeps; what comes later is worked out each time.
TABLE_SIZE = 200_000


class _Costs(dict):
    """Tokens of a blank and the piece; works out a missing one and keeps it while there is room."""

    def __init__(self, lib, room: int):
        super().__init__()
        self.lib, self.model, self.room = lib, lib.model, room
        self.simple = re.compile("([A-Za-z]+)([.,]?)").fullmatch

    def __missing__(self, piece: str) -> int:
        # A blank and a Latin word are one pre-token, a point or comma after it another.
        word = self.simple(piece)
        if word:
            n = len(self.model.tokenize("Ġ" + word[1])) + len(word[2])
        else:
            n = len(self.lib.encode(" " + piece, add_special_tokens=False))
        if len(self) < self.room:
            self[piece] = n
        return n


class PrefixCounter:
    """Exact token counts for every prefix of a text."""

    def __init__(self, path: str, room: int = TABLE_SIZE):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        # The longest of the added tokens that start at the leftmost place, as in the library.
        added = sorted((t.content for t in self.lib.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = frozenset(added)
        self.between = re.compile("(" + "|".join(map(re.escape, added)) + ")").split if added else lambda text: [text]
        self.blank_inside = re.compile(r"\s \s").search
        self.costs = _Costs(self.lib, room)

    def whole(self, text: str) -> int:
        return len(self.lib.encode(text, add_special_tokens=False))

    def total(self, text: str) -> int:
        """The last entry of the text's prefix table."""
        return self.prefix_table(text)[1][-1]

    def prefix_table(self, text: str) -> tuple[list[int], list[int]]:
        """``(ends, total)``: cut points in code points and the exact count at each."""
        sizes, costs = [0], [0]
        for k, part in enumerate(self.between(text)):
            if k % 2:  # the string of an added token
                sizes.append(len(part))
                costs.append(1)
            elif self.blank_inside(part):
                for token, (b, e) in self.lib.pre_tokenizer.pre_tokenize_str(part):
                    sizes.append(e - b)
                    costs.append(len(self.model.tokenize(token)))
            elif part:
                split = part.split(" ")
                if split[0]:
                    sizes.append(len(split[0]))
                    costs.append(self.whole(split[0]))
                sizes += [len(p) + 1 for p in split[1:]]
                costs += map(self.costs.__getitem__, split[1:])
        return list(accumulate(sizes)), list(accumulate(costs))

    def count_at(self, text: str, n: int, table=None) -> int:
        """Tokens of ``text[:n]``.  White space at the cut may group in another
        way than in the whole text, so the lookup steps back over it."""
        ends, total = table or self.prefix_table(text)
        n = max(0, min(n, len(text)))
        i = bisect.bisect_right(ends, n) - 1
        if ends[i] == n and self._exact(text, ends, i):
            return total[i]
        if ends[i] < n and text[ends[i]:ends[i + 1]] in self.added and not self._added(text, ends, i):
            i -= 1  # part of an added token's string is plain text and may join the piece before
        while i and text[ends[i] - 1].isspace() and not (n > ends[i] + 1 and self._blank_first(text, ends, i)):
            i -= 1
        return total[i] + self.whole(text[ends[i]:n])

    def _exact(self, text: str, ends: list[int], i: int) -> bool:
        """Whether the prefix up to ``ends[i]`` has as many tokens as the whole text has there."""
        return i == len(ends) - 1 or not text[ends[i] - 1:ends[i]].isspace() or self._blank_first(text, ends, i) \
            or text[ends[i]:ends[i + 1]] in self.added

    @staticmethod
    def _blank_first(text: str, ends: list[int], i: int) -> bool:
        """Whether the piece after ``ends[i]`` is a blank and something visible."""
        at = ends[i]
        return text[at] == " " and ends[i + 1] > at + 1 and not text[at + 1].isspace()

    def _added(self, text: str, ends: list[int], i: int) -> bool:
        """Whether nothing, or the string of an added token, ends at ``ends[i]``."""
        return i == 0 or text[ends[i - 1]:ends[i]] in self.added

    def cut(self, text: str, budget: int, table=None) -> int:
        """Code points of the longest prefix of whole pieces with at most ``budget`` tokens."""
        ends, total = table or self.prefix_table(text)
        i = bisect.bisect_right(total, budget) - 1
        # A prefix that ends in white space may group it in another way than the text does.
        while i + 1 < len(ends) and not self._exact(text, ends, i + 1):
            i += 1
        while i and self.count_at(text, ends[i], (ends, total)) > budget:
            i -= 1
        return ends[i]


def counter(path: str) -> PrefixCounter:
    """One per worker process, kept from task to task."""
    return held(("counter", path), lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, cut_chars`` per row of ``docs(doc_id, text)``.

    ``cut_chars`` is the longest prefix of whole pieces within ``limit`` tokens (the
    whole text where it fits).  Map only: no shuffle at any size.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_()), ("cut_chars", pa.int64())])

    def count(batch):
        c = counter(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        tokens, cuts = [], []
        for t in texts:
            table = c.prefix_table(t)
            tokens.append(table[1][-1])
            cuts.append(c.cut(t, limit, table) if tokens[-1] > limit else len(t))
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens, "over_limit": [n > limit for n in tokens],
                "cut_chars": cuts}

    return docs.select("doc_id", "text").mapInArrow(
        arrow_map(count, schema), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


@register("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document by the byte-level vocabulary."""
    import public_tokenizers
    return token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(VOCABULARY))
