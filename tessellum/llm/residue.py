"""Problem 9: records that hold template residue, filler, error pages or demands for scripts instead of content.

A regularized linear classifier decides. Its features are hashed: words, pairs and triples of words, the form of what stands
between two signs (so that a slot is known by its form, whatever its name), that form with the word before it and with the word
after it (sentences about slots differ from slots by these), the length of the record, how often it repeats itself, and the words
of its title. It is fitted to windows of records with weak labels: status lines and phrases of responses, the forms of template
slots, the words of filler. The score of a record is that of its best window; windows are differences of running sums, so every
position of every record counts, however long it is. A record is a case if its score reaches the threshold, and nothing else
is asked: the expressions below only label the training windows.

Hosts are split: most are fitted, some set the threshold (the best F1 against the weak labels of whole records), and the rest are
seen by neither; `validation` measures on these. Every record has its part in one of the three. Records are fitted in shards of
about SHARD records, by the hashes of their ids, each in one task; the weights are the mean of those of all shards (iterative
methods would read all windows once a step). A record is fitted by up to WINDOWS or PLAIN windows of each kind, so that long
records do not drown the others; scores cover all windows of all records, whole.

Defined results: null and blank texts and texts without words or signs are no cases; repeated rows count once; texts of any
length are scored in one pass; an empty table, or one without weak labels of both kinds among the fitted hosts, gives no
cases; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.session import cut

#: Tokens per window, step between training windows, bits of hashed features, records of a shard, windows of each record that
#: are cases or near one, and windows that are neither.
WINDOW, STEP, BITS, SHARD, WINDOWS, PLAIN = 12, 6, 18, 40_000, 6, 2
#: Strength of the squared penalty, steps of the optimizer.
PENALTY, PASSES = 1e-5, 200
#: Parts into which hosts are divided: part 0 is held out, part 1 sets the threshold, the others are fitted.
PARTS = 5
#: Characters of the texts that one step of the scoring takes together.
CHUNK = 1_000_000

TOKEN = re.compile(r"[^\W\d_]+|\d+|\{\{|\}\}|\[\[|\]\]|<%=?|%>|[$#%]\{|\{%|%\}|@@|%%|__|«|»|&lt;|&gt;|\.\.\.|…|[<>{}\[\]()$\"'`:/%]")
HOST = r"https?://([^/\s,;)>\"']+)"

# What the weak labels know.
FIELD = r"[A-Za-z][A-Za-z]*(?:[ _-][A-Za-z]+){0,3}"
#: Forms in which template languages and boilerplates mark what somebody should fill in.
SLOT = re.compile(
    r"\{\{\s*" + FIELD + r"\s*\}\}|\[\[\s*" + FIELD + r"\s*\]\]|<%=?\s*" + FIELD + r"\s*%>|[$#]\{\s*" + FIELD + r"\s*\}|(?<![%$#{\w\\])\{\s*" + FIELD + r"\s*\}(?!\})"
    r"|<(?:your|insert|enter|add)\s[^<>\n]+>|<[^<>\n]+\s(?:goes\s)?here>|\[(?:TODO|INSERT|YOUR|ENTER|FILL IN)\b[^\]\n]*\]|\((?:fill in|insert|your)\s[^()\n]+\)"
    r"|@@\w+@@|%%\w+%%|(?<![\w])__[A-Z][A-Z_]*?__(?!\w)|\$[A-Z][A-Z_]+\$|\bXX_[A-Z_]+_XX\b|\{%\s*block\s[^%]*%\}|«" + FIELD + r"»|&lt;\s*" + FIELD + r"\s*&gt;",
)
#: What stands around a slot in a sentence about slots: before it and after it.
ABOUT_BEFORE = re.compile(r"(?i)(?:\b(?:variables?|macros?|write|writes|type|line with|lines with|such as|called|named|placeholders?|slots?|tags?|token|tokens|expands?|replaces?|of the form|like)\s+[\"'`]?)$")
ABOUT_AFTER = re.compile(r"(?i)^[\"'`]?\s+(?:must be (?:set|exported)|is (?:set|kept|replaced|expanded|filled)|are (?:set|kept|replaced|expanded|filled)|in the template|expands|stands for)")

# The words of the usual Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum mauris massa augue risus varius porta ornare odio "
    "semper vitae lectus felis congue turpis eget justo tellus nunc vel donec praesent vestibulum pellentesque morbi tincidunt".split()
)
LATIN_SHARE = 0.8
#: What stands where content is missing. Once it may be a remark, twice in a window it is filler.
MISSING = re.compile(r"(?i)(?<![^\W_])(?:tbd|tba|tbc|wip|xxx+|n/a|to do|coming soon|under construction|to be (?:done|written|added|defined|announced)|insert content|content here|none yet|à venir)(?![^\W_])|(?m:^\W*\.\.\.\W*$)")

#: Status lines, as titles of responses.
STATUS = re.compile(
    r"(?i)^\W*(?:(?:http(?:/\d(?:\.\d)?)?\s+)?(?:error|fehler|erreur|status)?\s*:?\s*[45]\d\d\b(?!\s*(?:files|runs|days|times|items))|not found\b|page not found|page introuvable|seite nicht gefunden|p[aá]gina no encontrada|access denied|acceso denegado|acc[eè]s refus[eé]|zugriff verweigert|forbidden\b"
    r"|bad gateway|gateway time-?out|internal server error|service unavailable|too many requests|session expired|sitzung abgelaufen|database connection failed|site maintenance|under maintenance|something went wrong|oops\b|sorry\b|unauthorized\b|an error (?:has )?occurred)"
)
#: Words of a title that is nothing but a status line.
STATUS_WORDS = 8
#: Phrases of error, login, blocking and maintenance pages and of demands for scripts, in lower case.
PHRASES = (
    "moved or was removed", "moved or been removed", "does not exist on this server", "gibt es auf diesem server nicht", "no existe en este servidor", "n'existe plus ou a été déplacée", "not find what you were looking for",
    "could not finish your request", "cannot connect to the store", "cannot connect to the database", "did not answer in time", "sent too many requests", "have permission to open", "have permission to view", "have permission to access",
    "request was blocked by", "blocked by our protection", "down for maintenance", "will be back shortly", "please sign in", "please log in", "sign in again", "melden sie sich an", "private or has been deleted",
    "checking your browser before", "verify you are human", "are you a robot", "session has expired", "session expired", "try again later", "write to the webmaster",
    "enable javascript", "activate javascript", "allow javascript", "turn on javascript", "aktivieren sie javascript", "activer javascript", "activez javascript", "active javascript", "habilite javascript",
    "javascript is disabled", "javascript is required", "javascript is turned off", "javascript is not enabled", "requires javascript to", "needs javascript to", "scripts are turned off", "scripts are disabled", "scripts are blocked",
    "browser does not run scripts", "browser does not support scripts", "browser does not run javascript", "browser does not support javascript", "scripts must be allowed", "enable scripts", "allow scripts for", "without javascript enabled",
)


def flat(text: str) -> str:
    """The text as one line, without the comment signs and list marks that begin its lines."""
    return " ".join(re.sub(r"(?m)^\s*(?://+|#+|\*+|--+|;+|-)(?=\s|$)\s*", "", text).split())


def title_of(text: str) -> str:
    """The first line that is not blank."""
    return next((s.strip() for s in text.split("\n") if s.strip()), "")


def slots(line: str) -> list[tuple[int, bool]]:
    """Where slots end, and whether each is the subject of its sentence."""
    return [(m.end(), bool(ABOUT_BEFORE.search(line[max(0, m.start() - 40) : m.start()]) or ABOUT_AFTER.search(line[m.end() : m.end() + 40]))) for m in SLOT.finditer(line)]


def again(text: str) -> tuple[int, int]:
    """How many sentences or lines a text has, and how many different ones."""
    parts = [p for p in (s.strip() for s in re.split(r"[.!?\n]+", text.lower())) if p]
    return len(parts), len(set(parts))


def repeated(words: list[str]) -> bool:
    """Whether the same few words come again and again."""
    return len(words) >= 9 and 3 * len(set(words)) <= len(words)


def weak_labels(text: str) -> list[tuple[int, int, bool, bool]]:
    """(first token, end, label, near) of the training windows of a record, from single phrases and forms. A window is near a case if
    a slot stands in it that is the subject of its sentence: the fit always takes these."""
    line = flat(text)
    places = [m.span() for m in TOKEN.finditer(line)]
    low, words = line.lower(), [line[a:b].lower() for a, b in places]
    n = len(places)
    placed = slots(line)
    ends, subjects = [e for e, about in placed if not about], [e for e, about in placed if about]
    missing = [m.start() for m in MISSING.finditer(text if "..." in text else line)]
    for phrase in PHRASES:
        at = low.find(phrase)
        while at >= 0:
            ends.append(at + len(phrase))
            at = low.find(phrase, at + 1)
    title = title_of(text)
    parts, different = again(text)
    whole = parts >= 3 and 4 * different <= parts + 1 or bool(STATUS.search(title)) and len(title.split()) <= STATUS_WORDS or len(missing) >= 2 and 4 * len(missing) >= len(line.split()) / 2
    of_token = np.array([b for _, b in places])

    def counted(ends: list[int]) -> np.ndarray:
        at = np.minimum(np.searchsorted(of_token, np.array(ends, np.int64)), max(n - 1, 0))
        return np.concatenate([[0], np.cumsum(np.bincount(at, minlength=max(n, 1)))])

    marks, told = counted(ends), counted(subjects)
    is_word = np.array([w[0].isalpha() for w in words], bool)
    of_words, latin = np.concatenate([[0], np.cumsum(is_word)]), np.concatenate([[0], np.cumsum([w in LATIN for w in words])])
    out = []
    for at in range(0, max(1, n - STEP), STEP) if n else ():
        end = min(at + WINDOW, n)
        filler = of_words[end] - of_words[at] >= WINDOW / 2 and latin[end] - latin[at] >= LATIN_SHARE * (of_words[end] - of_words[at])
        same = end - at >= 9 and repeated(words[at:end])
        out.append((at, end, bool(whole or filler or same or marks[end] > marks[at]), bool(told[end] > told[at])))
    return out


class _Codes(dict):
    """The hash of a token without regard to case, and in its two lowest bits what it is: a word, one in capitals, a number, a
    sign. Remembers the tokens it has met, up to a bounded number."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        kind = 2 if token[0].isdigit() else 3 if not token[0].isalpha() else 1 if len(token) > 1 and token.isupper() else 0
        self[token] = code = (zlib.crc32(b"0" if kind == 2 else token.lower().encode()) << 2) | kind
        return code


_CODES = _Codes()
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
_NONE = 1 << BITS  # the place of a feature that isn't there


def _hashed(x: np.ndarray) -> np.ndarray:
    """A place below 2^BITS, by a 64-bit finalizer (the public SplitMix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - BITS)).astype(np.int64)


def coded(texts: list[str]) -> list[list[int]]:
    """The token codes of each text."""
    return [[_CODES[t] for t in TOKEN.findall(flat(text))] for text in texts]


def features(records: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(start of each record, features of each token) of the token codes of several records, with empty places between them. A
    token's features look back at the tokens before it and ahead by three, never into another record."""
    sizes = np.array([len(r) for r in records], np.int64)
    starts = 3 + np.concatenate([[0], np.cumsum(sizes + 3)])[:-1]
    total = int(sizes.sum() + 3 * len(sizes)) + 3
    place = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(int(sizes.sum()))
    code, real = np.zeros(total, np.uint64), np.zeros(total, bool)
    code[place] = np.fromiter(chain.from_iterable(records), np.uint64, int(sizes.sum()))
    real[place] = True
    word, kind, at = code >> np.uint64(2), code & np.uint64(3), np.arange(total)
    back = lambda k: np.concatenate([np.zeros(k, np.uint64), word[:-k]])
    sign = (kind == 3) & real
    opener = np.concatenate([[0], np.maximum.accumulate(np.where(sign | ~real, at, 0))[:-1]])
    capitals, small = np.cumsum((kind == 1) & real), np.cumsum((kind == 0) & real)
    shout = (capitals > capitals[opener]) & (small == small[opener])
    form = word[opener] * _ODD[0] + np.minimum(at - opener - 1, 5).astype(np.uint64) * _ODD[1] + shout.astype(np.uint64) * _ODD[2] + word * _ODD[3]
    paired = sign & sign[opener]
    ahead = lambda k: np.concatenate([word[k:], np.zeros(k, np.uint64)])
    before, after = word[np.maximum(opener - 1, 0)], ahead(1)
    follows = (after * _ODD[0] + ahead(2)) * _ODD[1] + ahead(3)
    single = word * _ODD[0] + np.uint64(1)
    columns = [_hashed(single), _hashed(back(1) * _ODD[1] + word * _ODD[2] + np.uint64(2)), _hashed(back(2) * _ODD[4] + back(1) * _ODD[1] + word * _ODD[2] + np.uint64(3))]
    columns += [np.where(paired, _hashed(c), _NONE) for c in (form + np.uint64(4), form * _ODD[4] + before * _ODD[0] + np.uint64(5), form * _ODD[4] + after * _ODD[1] + np.uint64(6), form * _ODD[4] + follows * _ODD[1] + np.uint64(7))]
    out = np.stack(columns, 1)
    out[~real] = _NONE
    return starts, out


def record_features(text: str, codes: list[int]) -> np.ndarray:
    """Features of the whole record: its length in powers of two, the share of different words, the words and length of its title."""
    n, title = len(codes), TOKEN.findall(title_of(text))
    length = int(np.log2(n + 1))
    parts, different = again(text)
    named = [f"length {length}", f"sentences {8 * different // max(parts, 1)} {min(parts, 4)}", f"different {8 * len(set(codes)) // max(n, 1)} {min(length, 6)}", f"title length {int(np.log2(len(title) + 1))}", *(f"title {t.lower() if t[0].isalpha() else '0'}" for t in title)]
    return np.array([zlib.crc32(x.encode()) & (_NONE - 1) for x in named], np.int64)


def _part(id_col: str, text_col: str) -> Column:
    """The part of a record's host; records that name none are spread by their id."""
    host = F.coalesce(F.nullif(F.regexp_extract(text_col, HOST, 1), F.lit("")), F.concat(F.lit("none "), F.pmod(F.xxhash64(id_col), F.lit(1000)).cast("string")))
    return F.pmod(F.xxhash64(host), F.lit(PARTS)).cast("int")


def _hosts(base: DataFrame, which: str) -> DataFrame:
    """(part, doc_id, text) of all records of some parts of the hosts."""
    return base.select(_part("doc_id", "text").alias("part"), "doc_id", "text").where(which)


def _training(base: DataFrame) -> DataFrame:
    """(doc_id, label, features) of the windows that are fitted, of every record of the fitted hosts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            texts = batch["text"].tolist()
            codes = coded(texts)
            starts, each = features(codes)
            for i, text, own, start in zip(batch["doc_id"], texts, codes, starts, strict=True):
                labels = weak_labels(text)
                order = sorted(labels, key=lambda x: (not x[3], zlib.crc32(f"{i} {x[0]}".encode())))
                whole = record_features(text, own)
                for at, end, label, _ in (x for side in (True, False) for x in [y for k, y in enumerate(z for z in order if z[2] == side) if k < (WINDOWS if side or y[3] else PLAIN)]):
                    f = each[start + at : start + end].ravel()
                    out.append((i, label, np.concatenate([f[f < _NONE], whole]).astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "label", "features"])

    return _hosts(base, "part > 1").mapInPandas(of, "doc_id long, label boolean, features array<int>")


def fit(label: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with a squared penalty; both labels weigh the same. Adam over all rows."""
    label = label.astype(float)
    sizes = np.array([len(r) for r in rows])
    column, first = np.concatenate(rows).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    weight = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    w, bias = np.zeros(_NONE), 0.0
    m, v, mb, vb = np.zeros(_NONE), np.zeros(_NONE), 0.0, 0.0
    for step in range(1, PASSES + 1):
        score = np.add.reduceat(w[column], first) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label) * weight
        g = np.bincount(column, np.repeat(error, sizes), _NONE) + PENALTY * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        bias -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, float(bias)


def fit_shards(windows: DataFrame, shards: int) -> tuple[np.ndarray, float] | None:
    """The mean of the weights and biases of all shards; a shard without windows of both labels has none. None if no shard has."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        label = rows["label"].to_numpy(bool)
        if not label.any() or label.all():
            return pd.DataFrame({"w": [], "bias": []})
        rows = rows.assign(n=rows.features.map(len)).sort_values(["doc_id", "label", "n"], kind="stable")
        w, bias = fit(rows["label"].to_numpy(bool), [np.asarray(f) for f in rows["features"]])
        return pd.DataFrame({"w": [w.tobytes()], "bias": [bias]})

    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).alias("shard")
    n, w, bias = 0, np.zeros(_NONE), 0.0
    # the driver adds up the weights of one partition of shards after the other
    for row in cut(windows.select(shard, "doc_id", "label", "features").groupBy("shard").applyInPandas(of, "w binary, bias double")).toLocalIterator():
        n, w, bias = n + 1, w + np.frombuffer(row.w), bias + row.bias
    return (w / n, bias / n) if n else None


def best_scores(texts: list[str], w: np.ndarray, bias: float) -> np.ndarray:
    """The highest score of any window of each record; minus infinity for those without a token."""
    codes = coded(texts)
    starts, each = features(codes)
    sums = np.concatenate([[0.0], np.cumsum(np.append(w, 0.0)[each].sum(1))])
    out = np.full(len(texts), -np.inf)
    for k, (text, own, start) in enumerate(zip(texts, codes, starts, strict=True)):
        if own:
            end, width = start + len(own), min(WINDOW, len(own))
            out[k] = (sums[start + width : end + 1] - sums[start : end + 1 - width]).max() + w[record_features(text, own)].sum() + bias
    return out


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about CHUNK characters together."""
    start = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text) > CHUNK:
            yield start, k
            start, held = k, 0
        held += len(text)
    if texts:
        yield start, len(texts)


def scored(base: DataFrame, model: dict, label: bool = False) -> DataFrame:
    """base with the score of each record and, if asked for, its weak label."""
    # the weights have a fixed size
    shared = base.sparkSession.sparkContext.broadcast((model["w"], model["bias"]))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, bias = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            best = np.concatenate([np.empty(0), *(best_scores(texts[a:b], w, bias) for a, b in _chunks(texts))])
            out = batch.drop(columns="text").assign(score=best)
            yield out.assign(label=[any(x[2] for x in weak_labels(t)) for t in texts]) if label else out

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name != "text")
    return base.mapInPandas(of, f"{kept}, score double" + (", label boolean" if label else ""))


def best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The score from which on the F1 against the labels is best, halfway to the next lower one; zero without positives."""
    if not label.any():
        return 0.0
    order = np.argsort(-score, kind="stable")
    f1 = 2 * np.cumsum(label[order]) / (np.arange(1, len(order) + 1) + label.sum())
    f1[:-1][score[order][:-1] == score[order][1:]] = -1  # equal scores are on one side
    k = int(f1.argmax())
    return float(score[order[k]] if k + 1 == len(order) else (score[order[k]] + max(score[order[k + 1]], score[order[k]] - 1)) / 2)


def _base(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return records.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))


def train(base: DataFrame) -> dict | None:
    """Weights, bias and threshold; None without both labels among the fitted hosts."""
    fitted = fit_shards(_training(base), -(-max(base.count(), 1) // SHARD))
    if fitted is None:
        return None
    model = {"w": fitted[0], "bias": fitted[1]}
    # a score and a label of each record of one part of the hosts
    judged = scored(_hosts(base, "part = 1"), model, label=True).select("score", "label").toArrow()
    return model | {"threshold": best_threshold(judged["score"].to_numpy(), judged["label"].to_numpy())}


def found(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id) of the records that the classifier takes for residue."""
    base = _base(records, id_col, text_col)
    model = train(base)
    if model is None:
        return base.select("doc_id").where(F.lit(False))
    return scored(base, model).where(F.col("score") >= model["threshold"]).select("doc_id").distinct()


def validation(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(threshold, records, positives, found, both, recall, precision): the classifier against the weak labels of all
    records of hosts that neither the weights nor the threshold have seen."""
    base = _base(records, id_col, text_col)
    model = train(base)
    if model is None:
        return records.sparkSession.createDataFrame([], "threshold double, records long, positives long, found long, both long, recall double, precision double")
    hit, label = F.col("score") >= model["threshold"], F.col("label")
    counts = scored(_hosts(base, "part = 0"), model, label=True).agg(F.count("*").alias("records"), F.count_if(label).alias("positives"), F.count_if(hit).alias("found"), F.count_if(hit & label).alias("both"))
    share = lambda of: F.when(F.col(of) > 0, F.col("both") / F.col(of))
    return counts.select(F.lit(model["threshold"]).alias("threshold"), "*", share("positives").alias("recall"), share("found").alias("precision"))
