"""Personal information in free text, by weak supervision.

Regular expressions propose spans; regex, gazetteer and context labelers vote
on them (``pii_rules``). Expectation-maximisation over the counts of the vote
patterns of the whole corpus estimates how reliable each vote is, and so how
likely a span of each pattern is personal. With these likelihoods as soft
labels a span classifier (logistic regression on hashed features of the span's
words, form and surroundings, not of its votes) is trained on a bounded sample
of spans. Both together decide on all spans.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.pii_rules import FEATURE_BITS, TYPES, Candidate, Finder
from folioweave.session import checkpoint

#: Spans of each type that the classifier is fitted on, the first by a hash of document and place.
SAMPLE_SPANS = 20_000
#: Vote patterns of a type are at most 3 to the number of its labelers; a gazetteer with more names is an error.
MAX_NAMES = 1_000_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON_NAME]"}

_SPAN = "STRUCT<pii_type: STRING, start: INT, end: INT, pii_text: STRING, votes: BINARY, features: BINARY>"
_SPAN_ARROW = pa.struct(
    [
        ("pii_type", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("pii_text", pa.string()),
        ("votes", pa.binary()),  # a byte each, one more than the vote
        ("features", pa.binary()),  # two bytes each
    ]
)


@dataclass
class Model:
    """Reliabilities of the votes, and the span classifier's weights."""

    prior: dict[str, float]
    reliability: dict[str, np.ndarray]  # type -> labeler x class x vote (-1, 0, 1)
    weights: np.ndarray

    def vote_odds(self, pii_type: str, votes: bytes) -> float:
        """Logarithm of the odds that a span with these votes is personal, by the labelers' reliabilities alone."""
        return self._sum(pii_type, enumerate(votes)) + float(np.log(self.prior[pii_type] / (1 - self.prior[pii_type])))

    def evidence(self, pii_type: str, votes: bytes) -> float:
        """How much the yes and no votes of a span multiply its odds, as a logarithm.

        Abstentions don't count: that a list or a cue is silent says much about
        the spans that it was estimated on, but nothing against a span of a new kind.
        """
        return self._sum(pii_type, ((j, v) for j, v in enumerate(votes) if v))

    def _sum(self, pii_type: str, votes: Iterator[tuple[int, int]]) -> float:
        theta = self.reliability[pii_type]
        return float(sum(np.log(theta[j, 1, v] / theta[j, 0, v]) for j, v in votes))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Reliability of each labeler, the share of the positive class, and each pattern's likelihood of it.

    ``votes`` has a row a pattern with a -1, 0 or 1 of each labeler; an
    abstention tells something too. The majority of yes and no is only where it
    starts; the positive class is the one that has more of the yes votes.
    """
    seen = (votes[:, :, None] == np.array([-1, 0, 1])[None, None, :]).astype(float)
    score = (votes == 1).sum(1) - (votes == 0).sum(1)
    q, total = 1 / (1 + np.exp(1.0 - 2.0 * score)), counts.sum()
    for _ in range(rounds):
        mass = np.stack([counts * (1 - q), counts * q])
        theta = np.einsum("cp,pjv->jcv", mass, seen) + 0.5
        theta /= theta.sum(2, keepdims=True)
        prior = (mass[1].sum() + 1) / (total + 2)
        log = np.einsum("pjv,jcv->pc", seen, np.log(theta)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    yes, no = theta[:, :, 2], theta[:, :, 1]
    if (np.log(yes[:, 1] / yes[:, 0]) - np.log(no[:, 1] / no[:, 0])).sum() < 0:
        theta, prior, q = theta[:, ::-1], 1 - prior, 1 - q
    return theta, float(prior), q


def train(features: list[np.ndarray] | list[list[int]], labels: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on sets of hashed features with soft labels (Adagrad, full batches)."""
    weights = np.zeros(1 << FEATURE_BITS)
    if not features:
        return weights
    lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    flat = np.concatenate(features).astype(np.int64)
    row = np.repeat(np.arange(len(features)), lengths)
    square = np.full_like(weights, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(row, weights[flat], len(features))))
        gradient = np.bincount(flat, (p - labels)[row], len(weights)) / len(features) + decay * weights
        square += gradient**2
        weights -= 0.5 * gradient / np.sqrt(square)
    return weights


def gazetteer(names: DataFrame) -> tuple[set[str], set[str]]:
    """Given and family names in small letters, of (name_part, part_kind)."""
    rows = names.select("name_part", "part_kind").na.drop().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    by: dict[str, set[str]] = defaultdict(set)
    for r in rows:
        by[r.part_kind].add(r.name_part.lower())
    return by["given"], by["family"]


def propose(documents: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Candidate spans of every document that has any: doc_id, spans; with ``keep_text`` of every document, and its text.

    Null and empty texts have none. Texts are searched whole; rows that repeat,
    and null ids, are documents of their own; other columns are not looked at.
    A gazetteer without names leaves its labelers silent.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(Finder(*gazetteer(names)))
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if not keep_text:
        docs = docs.filter("text <> ''")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shipped.value
        for batch in batches:
            kept, ends = [], [0]
            columns: list[list] = [[] for _ in _SPAN_ARROW]
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = finder.candidates(text) if text else ()
                for c in found:
                    for column, x in zip(columns, _told(text, c), strict=True):
                        column.append(x)
                if found or keep_text:
                    kept.append(i)
                    ends.append(len(columns[0]))
            structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN_ARROW, strict=True)], fields=list(_SPAN_ARROW))
            rows = batch.take(pa.array(kept, pa.int64()))
            own = [*rows.columns] if keep_text else [rows.column(0)]
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([*own, spans], names=["doc_id", *["text"] * keep_text, "spans"])

    return docs.mapInArrow(find, f"doc_id BIGINT, {'text STRING, ' if keep_text else ''}spans ARRAY<{_SPAN}>")


def _told(text: str, c: Candidate) -> tuple:
    """A candidate as the fields of ``_SPAN_ARROW``."""
    return c.pii_type, c.start, c.end, text[c.start : c.end], bytes(v + 1 for v in c.votes), array("H", c.features).tobytes()


def _row(text: str, c: Candidate) -> dict:
    return dict(zip((f.name for f in _SPAN_ARROW), _told(text, c), strict=True))


def fit(proposed: DataFrame, sample_spans: int = SAMPLE_SPANS) -> Model:
    """The model of a corpus's candidates: vote counts of all of them, the classifier from a sample.

    Every type has its own prior, reliabilities and sample. Without any
    candidates the classifier accepts nothing.
    """
    spans = proposed.select("doc_id", F.inline("spans"))
    patterns = spans.groupBy("pii_type", "votes").agg(F.count("*").alias("n")).collect()  # at most 3**labelers a type
    prior, reliability, likelihood = {}, {}, {}
    for t in TYPES:
        rows = sorted((bytes(r.votes), r.n) for r in patterns if r.pii_type == t)
        if not rows:
            continue
        votes, counts = np.array([list(v) for v, _ in rows]) - 1, np.array([n for _, n in rows], dtype=float)
        reliability[t], prior[t], q = expectation_maximisation(votes, counts)
        likelihood |= {(t, v): p for (v, _), p in zip(rows, q, strict=True)}
    # The first spans of each type by a hash: one pass, nothing is shuffled, and no more come than the sample has room for, give or take chance.
    total = {t: sum(r.n for r in patterns if r.pii_type == t) for t in prior}
    place, wanted = F.xxhash64("doc_id", "start", "end"), F.lit(False)
    for t, n in total.items():
        last = min(2**63 - 1, -(2**63) + 2**64 * sample_spans // n)
        wanted = wanted | ((F.col("pii_type") == t) & (place <= last))
    drawn = spans.filter(wanted).select("pii_type", place.alias("place"), "votes", "features").collect() if prior else []
    features, labels, room = [], [], dict.fromkeys(prior, sample_spans)
    for r in sorted(drawn, key=lambda r: (r.pii_type, r.place, bytes(r.votes), bytes(r.features))):
        if room[r.pii_type]:
            room[r.pii_type] -= 1
            features.append(np.frombuffer(r.features, np.uint16))
            labels.append(likelihood[r.pii_type, bytes(r.votes)])
    return Model(prior, reliability, train(features, np.array(labels)))


def span_odds(types: list[str], votes: list[bytes], features: list[bytes], model: Model) -> np.ndarray:
    """Logarithms of the spans' odds: those of the classifier and the evidence of the votes, taken together.

    The classifier knows a span's words, form and surroundings but not its votes,
    so that each corrects the other.
    """
    if not types:
        return np.zeros(0)
    starts = np.cumsum([0, *(len(f) // 2 for f in features[:-1])])
    sums = np.add.reduceat(model.weights[np.frombuffer(b"".join(features), np.uint16)], starts)
    voted: dict[tuple[str, bytes], float] = {}
    for key in set(zip(types, votes, strict=True)):
        voted[key] = model.evidence(*key)
    return np.clip(sums + np.array([voted[k] for k in zip(types, votes, strict=True)]), -500, 500)


def choose(spans: list[dict], model: Model, threshold: float = 0.5) -> list[dict]:
    """The accepted spans of a document, no two of which overlap, in order.

    Of overlapping ones of a type the likelier counts, in three classes (odds of
    20 and of 400 to one part them), then the longer, then the earlier; of those
    of several types the likelier.
    """
    odds = span_odds([s["pii_type"] for s in spans], [s["votes"] for s in spans], [s["features"] for s in spans], model)
    limit = np.log(threshold / (1 - threshold))
    return _sorted_out([(s, x) for s, x in zip(spans, odds.tolist(), strict=True) if x > limit])


def _sorted_out(scored: list[tuple[dict, float]]) -> list[dict]:
    scored.sort(key=lambda x: (-min(2, int(x[1] // 3)), x[0]["start"] - x[0]["end"], x[0]["start"]))
    scored = _apart(scored, across=False)
    scored.sort(key=lambda x: (-x[1], x[0]["start"] - x[0]["end"], x[0]["start"], x[0]["pii_type"]))
    return sorted((s for s, _ in _apart(scored, across=True)), key=lambda s: s["start"])


def _chosen(lists: pa.ListArray, model: Model) -> Iterator[list[dict]]:
    """:func:`choose` for every row of a batch; only what is likely leaves Arrow."""
    offsets, flat = lists.offsets.to_pylist(), lists.flatten()
    odds = span_odds(*(flat.field(n).to_pylist() for n in ("pii_type", "votes", "features")), model)
    likely = np.flatnonzero(odds > 0)
    names = ["pii_type", "start", "end", "pii_text"]
    parts = (flat.field(n).take(pa.array(likely)).to_pylist() for n in names)
    told = [(dict(zip(names, values, strict=True)), x) for values, x in zip(zip(*parts, strict=True), odds[likely].tolist(), strict=True)]
    at = np.searchsorted(likely, np.array(offsets) - offsets[0]).tolist()
    for low, high in zip(at[:-1], at[1:], strict=True):
        yield _sorted_out(told[low:high]) if high > low else []


def _apart(scored: list[tuple[dict, float]], across: bool) -> list[tuple[dict, float]]:
    """The spans that overlap none before them in the order given: of their type, or of any if ``across``."""
    taken: list[tuple[dict, float]] = []
    for s, x in scored:
        if all(s["end"] <= t["start"] or s["start"] >= t["end"] for t, _ in taken if across or t["pii_type"] == s["pii_type"]):
            taken.append((s, x))
    return taken


def find_spans(proposed: DataFrame, model: Model) -> DataFrame:
    """Accepted spans: doc_id, pii_type, start, end (code points), pii_text as in the text."""
    shipped = proposed.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, spans in zip(batch.column(0).to_pylist(), _chosen(batch.column(1), shipped.value), strict=True):
                for s in spans:
                    for column, x in zip(out, (doc_id, s["pii_type"], s["start"], s["end"], s["pii_text"]), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "pii_type", "start", "end", "pii_text"]
            )

    return proposed.mapInArrow(find, "doc_id BIGINT, pii_type STRING, start INT, end INT, pii_text STRING")


def redact(documents: DataFrame, names: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`redacted` documents, by a model that was fitted before."""
    return redacted(propose(documents, names, id_col, text_col, keep_text=True), model)


def redacted(proposed: DataFrame, model: Model) -> DataFrame:
    """Every document with placeholders for its accepted spans: doc_id, text, n_replaced.

    ``proposed`` has kept the texts. One row for each document; all else of a
    text is unchanged, null and empty texts too.
    """
    shipped = proposed.sparkSession.sparkContext.broadcast(model)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, spans in zip(batch.column(1).to_pylist(), _chosen(batch.column(2), shipped.value), strict=True):
                parts, at = [], 0
                for s in spans:
                    parts += [text[at : s["start"]], PLACEHOLDERS[s["pii_type"]]]
                    at = s["end"]
                texts.append("".join([*parts, text[at:]]) if spans else text)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_replaced"]
            )

    return proposed.mapInArrow(replace, "doc_id BIGINT, text STRING, n_replaced INT")


def redact_personal(documents: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`redacted` documents with a model of themselves; texts and candidates go to the checkpoint folder, and are read once."""
    proposed = checkpoint(propose(documents, names, id_col, text_col, keep_text=True))
    return redacted(proposed, fit(proposed))


def find_personal(documents: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`find_spans` with a model of the same documents; their candidates go to the checkpoint folder."""
    proposed = checkpoint(propose(documents, names, id_col, text_col))
    return find_spans(proposed, fit(proposed))
