"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a prefix ends in one token only, and dropping that token leaves the encoding of a shorter
prefix. So one last token for each byte prefix describes every encoding: it is the token that ends there and
may follow the last token of what precedes it. Appending bytes continues the table; an edit keeps the table
up to the edited byte.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from railspan.llm.common import bound_batches, only

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(lines) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PrefixEncoder:
    """Encodes byte strings by their prefixes' last tokens. Tokens are ranks; a rank tells when its merge takes place."""

    PAIRS = 600_000
    #: Tables of short beginnings that many words share, by their length; how many are kept.
    SHARED, BEGINNINGS = (8, 5), 100_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.shared = ranks, {}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The plain definition: join the pair of least rank, leftmost first, until no pair has a rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            least, at = min(((r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None), default=(None, -1))
            if least is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for a single byte, (-1, -1) if merges never make it."""
        if token not in self.halves:
            data, found = self.bytes_of[token], None
            if len(data) > 1:
                found = (-1, -1)
                if self.merged(data) == [data]:
                    for at in range(1, len(data)):  # merged apart, each half is whole, and the two meet
                        a, b = self.ranks.get(data[:at]), self.ranks.get(data[at:])
                        if a is not None and b is not None and self._whole(a) and self._whole(b) and self._meet(a, b, token):
                            found = (a, b)
                            break
            self.halves[token] = found
        return self.halves[token]

    def _whole(self, token: int) -> bool:
        return self._halves(token) != (-1, -1)

    def _meet(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge across the boundary comes before `limit` or before the merges that made the two.

        The later of the two merges is undone, time and again: until then, a merge across must not have been possible.
        """
        join, bytes_of = self.ranks.get, self.bytes_of
        while True:
            across = join(bytes_of[left] + bytes_of[right])
            if across is not None and across < limit:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left = left, a[1]
            else:  # equal ranks: the left one is made first, so the right one is undone first
                limit, right = right + 1, b[0]

    def follows(self, before: int, token: int) -> bool:
        """Whether the token may end an encoding whose previous token is `before` (-1: none)."""
        pair = (before, token)
        ok = self.pairs.get(pair)
        if ok is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            ok = self.pairs[pair] = self._whole(token) and (before < 0 or self._meet(before, token, float("inf")))
        return ok

    def table(self, data: bytes, last: list[int] | None = None, upto: int | None = None) -> list[int]:
        """The last token of each prefix (at 0: -1). `last`: a table of some first bytes, which is continued; upto: where it ends."""
        last = [-1] if last is None else last
        rank, known, follows, longest = self.ranks.get, self.pairs.get, self.follows, self.longest
        for end in range(len(last), (len(data) if upto is None else upto) + 1):
            for begin in range(end - 1, max(-1, end - longest - 1), -1):
                token = rank(data[begin:end])
                if token is not None:
                    ok = known((last[begin], token))
                    if ok or ok is None and follows(last[begin], token):
                        last.append(token)
                        break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")
        return last

    def word(self, data: bytes) -> list[int]:
        """The table of a short string, continued from that of a beginning which an earlier one had."""
        for size in self.SHARED:
            if len(data) > size:
                begin = data[:size]
                found = self.shared.get(begin)
                if found is None:
                    if len(self.shared) >= self.BEGINNINGS:
                        self.shared.clear()
                    found = self.shared[begin] = tuple(self.table(begin) if size == self.SHARED[-1] else self.word(begin))
                return self.table(data, list(found))
        return self.table(data)

    def edit(self, data: bytes, last: list[int], begin: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace data[begin:end] by new: prefixes up to `begin` stay, and those beyond are worked out until they agree with the old ones.

        A last token depends on as many bytes and last tokens before it as the longest token has: where so many agree, the rest does.
        """
        whole, fresh, shift = data[:begin] + new + data[end:], last[: begin + 1], len(new) - (end - begin)
        same, at = 0, begin + len(new)
        self.table(whole, fresh, at)
        while at < len(whole) and same < self.longest:
            at += 1
            self.table(whole, fresh, at)
            same = same + 1 if fresh[at] == last[at - shift] else 0
        return whole, fresh + last[at + 1 - shift :]

    def ids(self, last: list[int]) -> list[int]:
        """Walk back from the end of a table."""
        out, at, bytes_of = [], len(last) - 1, self.bytes_of
        while at:
            out.append(last[at])
            at -= len(bytes_of[last[at]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """As the reference tokenizer does: a string that is itself a token stays whole."""
        return [self.ranks[data]] if data in self.ranks else self.ids(self.word(data))


class Matches(dict):
    """Of a match of the splitting pattern: how many ids it has, their decimal string, and the bytes that they decode to.

    At most two halves of LIMIT bytes, about, are kept: when the newer one is full it becomes the older one, and what is used of that comes back.
    """

    LIMIT, EACH = 64 << 20, 300
    #: Longer matches are worked out each time.
    LONGEST = 64

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder, self.size, self.old = encoder, 0, {}

    def __missing__(self, match: str):
        found = self.old.get(match)
        if found is None:
            ids = self.encoder.encode(match.encode("utf-8", "surrogatepass"))
            found = (len(ids), " ".join(map(str, ids)), b"".join(map(self.encoder.bytes_of.__getitem__, ids)))
        if len(match) <= self.LONGEST:
            if self.size >= self.LIMIT:
                self.old, self.size = dict(self), 0
                self.clear()
            self.size += self.EACH + 8 * len(match)
            self[match] = found
        return found


def splitter(pattern: str):
    """The pattern's matches, with white space as the tokenizers' own engine knows it: this one's \\s has four control characters more."""
    import regex

    return regex.compile(pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall


def _run(ranks_blob, pattern: str):
    def run(batches):
        split = splitter(pattern)
        found = Matches(PrefixEncoder(read_ranks(ranks_blob.value.splitlines()))).__getitem__
        for batch in batches:
            cols: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                got = list(map(found, split(text or "")))
                counts, strings, data = zip(*got, strict=True) if got else ((), (), ())
                cols[0].append(sum(counts))
                cols[1].append(hashlib.sha256(" ".join(strings).encode()).hexdigest())
                cols[2].append(hashlib.sha256(b"".join(data)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text).

    ids_sha256 hashes the decimal ids joined by one space; decoded_sha256 the bytes that the ids decode to. A
    null text is empty: no tokens, and twice the hash of nothing. Rows are independent; other columns are
    ignored. The rank file (under 1 MB, read once by the driver) is broadcast.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(ranks_path, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())
    return only(docs, doc_id="long", text="string").mapInArrow(_run(blob, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(ranks_blob, pattern: str):
    def run(batches):
        encoder, split = PrefixEncoder(read_ranks(ranks_blob.value.splitlines())), splitter(pattern)
        for batch in batches:
            ids = [[i for m in split(t or "") for i in encoder.encode(m.encode("utf-8", "surrogatepass"))] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def token_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the ids themselves, for those who train on them."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(ranks_path, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())
    return only(docs, doc_id="long", text="string").mapInArrow(_ids(blob, pattern), "doc_id long, ids array<int>")
