"""Language identification by unigram piece models, with all segmentations summed.

A word, lower-cased and begun with a word mark, is any sequence of pieces of a fixed public vocabulary
that spells it. For each language the pieces have probabilities, fitted by expectation maximisation over
the segmentations of a bounded sample of labelled texts; the forward algorithm then sums a word's
probability over all of its segmentations. A text's score is the product over its words and the
language's share. Words are scored once for each worker and looked up by their hash afterwards.

A character that no piece spells is an unknown piece of a fixed probability. Sums are kept as logarithms, so
that words of any length have all of their segmentations summed; from LONG characters on a word is spelled
by itself, with as much of the sums as the longest piece reaches back. Words are lower-cased, so pieces with
capitals never stand in one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Words, blocks, crc_residue, fresh, kept_in_worker, mix, release

#: Bound of the training sample: documents of each language, chosen by a hash of doc_id.
SAMPLE_DOCS = 1000
#: Passes of expectation maximisation, added count of each piece, probability of an unknown character.
PASSES, ADDED, UNKNOWN = 3, 0.05, 1e-7
#: Characters from which a word is spelled by itself, cells (characters x words) of one table, and words whose scores a worker keeps.
LONG, CELLS, KEPT_WORDS = 400, 1 << 18, 2_000_000
MARK = "▁"
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_B = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(model_file: str) -> list[str]:
    """The spelled pieces of a public sentencepiece vocabulary, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(kind(i) for kind in kinds)]


class Vocabulary:
    """Piece ids by length and hash of the spelling."""

    def __init__(self, pieces: list[str]):
        pieces = [p for p in dict.fromkeys(pieces) if p == p.lower()]
        self.size = len(pieces)  # the unknown piece's id
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p in pieces}):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n])
            codes = np.array([[ord(c) for c in pieces[i]] for i in ids], dtype=np.uint64)
            h = np.zeros(len(ids), np.uint64)
            with np.errstate(over="ignore"):
                for column in codes.T:
                    h = mix(h * _B + column)
            order = np.argsort(h)
            self.by_length[n] = (h[order], ids[order])
        self.longest = max(self.by_length, default=1)

    def at_ends(self, codes: np.ndarray) -> np.ndarray:
        """For one word's codes: (its length, longest piece) ids of the pieces by end and length, -1 where there is none."""
        out = np.full((len(codes), self.longest), -1)
        h = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, min(len(codes), self.longest) + 1):
                h = mix(h[: len(codes) - n + 1] * _B + codes[n - 1 :])
                keys, ids = self.by_length.get(n, (np.zeros(0, np.uint64), np.zeros(0, int)))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[at] == h
                    out[np.flatnonzero(hit) + n - 1, n - 1] = ids[at[hit]]
        out[:, 0] = np.where(out[:, 0] < 0, self.size, out[:, 0])
        return out

    def edges(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of one length (rows of codes) and each end: (start, rows, piece ids) of the pieces that end there."""
        rows, length = codes.shape
        found: list[list] = [[] for _ in range(length + 1)]
        h = np.zeros((rows, length), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, min(length, self.longest) + 1):
                h = mix(h[:, : length - n + 1] * _B + codes[:, n - 1 :])
                keys, ids = self.by_length.get(n, (np.zeros(0, np.uint64), np.zeros(0, int)))
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(h.shape, bool)
                for start in range(length - n + 1):
                    if n == 1:
                        piece = np.where(hit[:, start], ids[at[:, start]], self.size) if len(keys) else np.full(rows, self.size)
                        found[start + 1].append((start, np.arange(rows), piece))
                    elif len(r := np.flatnonzero(hit[:, start])):
                        found[start + n].append((start, r, ids[at[r, start]]))
        return found


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes of words, their codes) for words of one length, as many as CELLS allow."""
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word) + 1, []).append(i)
    for n, index in by_length.items():
        step = max(1, CELLS // n)
        for k in range(0, len(index), step):
            part = index[k : k + step]
            yield np.array(part), _codes("".join(MARK + words[i] for i in part)).reshape(-1, n)


def _forward(edges: list, rows: int, logs: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over segmentations of each word's prefixes: (length + 1, rows, languages)."""
    a = np.full((len(edges), rows, logs.shape[1]), -np.inf)
    a[0] = 0
    for end, into in enumerate(edges):
        for start, r, piece in into:
            if start == end - 1:  # a character, of every row
                a[end] = a[start] + logs[piece]
        for start, r, piece in into:
            if start < end - 1:
                a[end, r] = np.logaddexp(a[end, r], a[start, r] + logs[piece])
    return a


def _long_forward(codes: np.ndarray, vocabulary: Vocabulary, logs: np.ndarray) -> np.ndarray:
    """The last row of `_forward` for one word of any length, a stretch of characters at a time."""
    m, step = vocabulary.longest, 1 << 14
    p = np.vstack([np.exp(logs), np.zeros(logs.shape[1])])  # the last one stands for no piece
    # sums of the last m prefixes, the latest first, in units of exp(scale)
    last, scale = np.zeros((m, logs.shape[1])), np.zeros(logs.shape[1])
    last[0] = 1
    for low in range(0, len(codes), step):
        before = min(low, m - 1)
        for pieces in vocabulary.at_ends(codes[low - before : low + step])[before:]:
            new = (last * p[pieces]).sum(axis=0)
            last[1:] = last[:-1]
            last[0] = new
            if new.min() < 1e-150:
                scale += np.log(new)
                last /= new
    return scale + np.log(last[0])


def word_scores(words: list[str], vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Each word's log probability by language."""
    out, logs = np.zeros((len(words), p.shape[1])), np.log(p)
    short = [i for i, w in enumerate(words) if len(w) < LONG]
    for index, codes in _groups([words[i] for i in short]):
        out[np.array(short)[index]] = _forward(vocabulary.edges(codes), len(codes), logs)[-1]
    for i in (i for i, w in enumerate(words) if len(w) >= LONG):
        out[i] = _long_forward(_codes(MARK + words[i]), vocabulary, logs)
    return out


def fit_pieces(words: list[str], counts: np.ndarray, vocabulary: Vocabulary, passes: int = PASSES) -> np.ndarray:
    """Piece probabilities (the unknown piece last) from a language's word counts, by forward-backward passes."""
    p = np.full(vocabulary.size + 1, 1.0 / max(1, vocabulary.size))
    p[-1] = UNKNOWN
    short = [i for i, w in enumerate(words) if len(w) < LONG]  # longer ones teach no pieces
    counts = counts[short]
    groups = [(index, len(codes), vocabulary.edges(codes)) for index, codes in _groups([words[i] for i in short])]
    for _ in range(passes):
        soft, logs = np.zeros(vocabulary.size + 1), np.log(p)[:, None]
        for index, rows, edges in groups:
            a = _forward(edges, rows, logs)[:, :, 0]
            b = np.full_like(a, -np.inf)
            b[-1] = np.log(counts[index]) - a[-1]
            for end in range(len(edges) - 1, 0, -1):
                for start, r, piece in edges[end]:
                    back = logs[piece, 0] + b[end, r]
                    b[start, r] = np.logaddexp(b[start, r], back)
                    soft += np.bincount(piece, weights=np.exp(a[start, r] + back), minlength=len(soft))
        soft[-1] = 0
        p = (soft + ADDED) / (soft.sum() + ADDED * vocabulary.size)
        p[-1] = UNKNOWN
    return p


class Model:
    """Languages with their shares and piece probabilities."""

    def __init__(self, languages: list[str], shares: np.ndarray, pieces: list[str], p: np.ndarray):
        self.languages, self.shares, self.pieces, self.p = languages, shares, pieces, p
        self.name = hashlib.blake2b(repr((languages, shares.tolist(), pieces)).encode("utf-8", "surrogatepass") + p.tobytes()).hexdigest()


def train(labelled: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled (doc_id, text, lang); rows with a null lang or text are left out.

    At most about `sample_docs` documents of each language are read whole, chosen by a hash of doc_id;
    the languages' shares count all labelled rows.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    if not languages:
        return Model([], np.zeros(0), [], np.zeros((0, 0)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1_000_000, -(-sample_docs * 1_000_000 // shares[k]))))])
    chosen = rows.where(draw < F.element_at(share, F.col("lang")))
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+")).alias("word")).where("word <> ''")
    table = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow()
    lang, word, n = np.array(table["lang"].to_pylist(), dtype=object), table["word"].to_pylist(), table["n"].to_numpy()
    vocabulary, p = Vocabulary(pieces), []
    for language in languages:
        own = np.flatnonzero(lang == language)
        order = own[np.argsort(np.array([word[i] for i in own], dtype=object), kind="stable")]
        p.append(fit_pieces([word[i] for i in order], n[order].astype(float), vocabulary))
    del table, lang, word, n
    release()  # the driver lives on
    total = sum(shares.values())
    return Model(languages, np.array([shares[k] / total for k in languages]), pieces, np.stack(p, axis=1))


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.vocabulary = model, Vocabulary(model.pieces)
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)), np.float32)

    def texts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Each text's log probability by language, the shares included."""
        words = Words(data, offs)
        unique, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_WORDS:
            self.keys, self.scores = self.keys[:0], self.scores[:0]
        at = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        new = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            spelled = [words.text(i).decode("utf-8", "replace").lower() for i in first[new]]
            keys = np.concatenate([self.keys, unique[new]])
            scores = np.concatenate([self.scores, word_scores(spelled, self.vocabulary, self.model.p).astype(np.float32)])
            order = np.argsort(keys)
            self.keys, self.scores = keys[order], scores[order]
            at = np.searchsorted(self.keys, unique)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(words.ptr))
        each = self.scores[at][back]
        sums = [np.bincount(doc, weights=each[:, k], minlength=len(offs) - 1) for k in range(each.shape[1])]
        return np.stack(sums, axis=1) + np.log(self.model.shares)


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with two more columns, the predicted language and its posterior (0 to 1); only `text` is read for them.

    A null text, one without a letter, and any text where no language was learned, is `und` with score 0. Texts
    and words are scored whole, whatever their length. Ties go to the language whose name comes first. Rows that
    repeat are predicted each. Columns of docs that have the new names give way. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in (lang, score)]
    schema = docs.select(*names).schema.add(lang, "string").add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer = kept_in_worker(("languages", known.name), lambda: _Scorer(known)) if known.languages else None
        for batch in batches:
            for i, j, data, offs, valid in blocks(batch.column("text")):
                part = batch.slice(i, j - i)
                texts = part.column("text").to_pylist()
                plain = np.array([bool(v and known.languages and _LETTER.search(t)) for v, t in zip(valid, texts, strict=True)])
                found, sure = np.full(j - i, UNDETERMINED, dtype=object), np.zeros(j - i)
                if plain.any():
                    s = scorer.texts(data, offs)
                    best = s.argmax(axis=1)
                    top = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                    found[plain] = np.array(known.languages, dtype=object)[best[plain]]
                    sure[plain] = top[plain]
                columns = [part.column(c) for c in names] + [pa.array(found, pa.string()), pa.array(sure)]
                del texts
                yield pa.RecordBatch.from_arrays(columns, names=[*names, lang, score])

    return docs.select(*names).mapInArrow(run, schema)


def held_out(modulus: int = 5):
    """Whether a row is kept from training: crc32 of doc_id as text, modulo `modulus`, is 0 (null doc_id: not)."""
    return F.coalesce(crc_residue("doc_id", modulus) == 0, F.lit(False))


def identify(docs: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Train on the rows of docs that are not held out, then predict every row: docs with lang_pred, lang_score, held_out."""
    model = train(docs.where(~held_out()), pieces, sample_docs)
    return predict(docs, model).withColumn("held_out", held_out())


def keep_identified(docs: DataFrame, pieces: list[str], least: float = 0.5) -> DataFrame:
    """docs without the rows whose language is undetermined or whose score is below `least`; all columns stay, whatever their names.

    Null, empty and letterless texts are undetermined and go. Rows that repeat are decided each. An empty
    table stays empty.
    """
    model = train(docs.where(~held_out()), pieces)
    lang, score = fresh(docs, "lang", "score")
    found = predict(docs, model, lang, score)
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)
