"""Line-first quality cleaning.

Every line is judged on its own (navigation, boilerplate, punctuation rules), failing lines are removed, and a document
that loses too much of its text is rejected. Rows stream through one Arrow map: no shuffle, memory bounded by a batch.

Null and empty texts have no words, so all counts are 0 and they fail the base rule. Repeated rows are judged one by
one. Very long texts are judged whole; a text at the limits (50 words, half of the words repeated, MAX_LOSS lost) passes. An empty table gives no rows.
Extra columns, whatever their names, are carried by `clean_lines` and ignored by `op8_line_quality`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Phrases that mark a boilerplate line, in English, German, French, Spanish, Italian and Portuguese.
BOILERPLATE = (
    "lorem ipsum", "javascript", "cookie policy", "use cookies", "terms of use", "terms of service", "privacy policy",
    "all rights reserved", "click here", "read more", "sign in", "log in", "subscribe now", "share this", "skip to content",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "verwenden cookies", "cookie-richtlinie", "hier klicken", "weiterlesen", "jetzt anmelden",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "utilisons des cookies", "cliquez ici", "lire la suite", "se connecter",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "utiliza cookies", "utilizamos cookies", "usamos cookies", "haga clic aquí", "leer más", "iniciar sesión",
    "tutti i diritti riservati", "informativa sulla privacy", "utilizza cookie", "clicca qui", "leggi tutto",
    "todos os direitos reservados", "política de privacidade", "termos de uso", "clique aqui", "leia mais",
)
#: A line of more words that holds such a phrase is prose and stays.
BOILER_WORDS = 20
#: A line needs this many separators to count as navigation.
NAV_MARKS = 3
#: A line of so few words without an end mark is a heading or menu entry. Longer ones may be prose without punctuation and stay.
#: In scripts that put no spaces between words, UNSPACED_CHARS characters count as a word.
MENU_WORDS, UNSPACED_CHARS = 6, 2
#: Thai to Lao, Burmese, Khmer, kana, and Chinese characters.
UNSPACED = "[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]"
#: Marks that end a sentence or clause, and what may follow them.
END_MARKS, CLOSERS = ".!?:;,…。！？、，；：؟؛،۔।॥።", "\"'”’»)\\]」』）"
#: Share of symbol characters in a line's word characters from which the line is junk.
SYMBOL_SHARE = 0.2
#: Share of a document's word characters that may be removed before it is rejected.
MAX_LOSS = 0.5

_BOILER = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, BOILERPLATE))})(?!\w)", re.I)
_MARKS = re.compile(r"[|»›•>]|&gt;")
_SYMBOLS = b"#*$%&|<>"
_SYMBOL_SET = frozenset("#*$%&|<>")
_WHITE = b" \t\n\x0b\x0c\r"
_LOWER = re.compile("[a-z]")
_END = re.compile(f"[{END_MARKS}][{CLOSERS}]*$")
_UNSPACED = re.compile(UNSPACED)


def line_fails(line: str) -> str | None:
    """The rule that a line with words breaks, or None."""
    s = line.strip(" \t\n\x0b\x0c\r")
    chars = len(s) - sum(map(s.count, " \t\x0b\x0c\r"))
    if len(_MARKS.findall(s)) >= NAV_MARKS:
        return "navigation"
    if sum(map(s.count, _SYMBOL_SET)) > SYMBOL_SHARE * chars:
        return "symbols"
    if s.count("!") >= 4 and not _LOWER.search(s):
        return "shouting"
    words = len(s.encode("utf-8", "surrogatepass").split())
    if words <= BOILER_WORDS and _BOILER.search(s):
        return "boilerplate"
    if words <= MENU_WORDS and words + (0 if s.isascii() else len(_UNSPACED.findall(s)) // UNSPACED_CHARS) <= MENU_WORDS and not _END.search(s):
        return "punctuation"
    return None


def clean_text(text: str | None) -> tuple[str, int, int]:
    """The text without its failing lines, the word characters it had, and those that were removed."""
    kept, total, lost = [], 0, 0
    for line in (text or "").split("\n"):
        n = len(line) - sum(map(line.count, " \t\x0b\x0c\r"))
        total += n
        if n and line_fails(line):
            lost += n
        else:
            kept.append(line)
    return "\n".join(kept), total, lost


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of `size` words that occur at least twice in the text, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    window = code[:n]
    for j in range(1, size):
        _, window = np.unique(window * len(ids) + code[j : n + j], return_inverse=True)
    hit = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for j in range(size):
        covered[j : n + j] |= hit
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = raw.translate(None, _WHITE)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    lines = [x for x in raw.split(b"\n") if x.strip(_WHITE)]
    return len(words), chars, len(joined) - len(joined.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def verdict(n_words: int, n_repeat: int, total: int, lost: int, max_loss: float) -> tuple[bool, bool]:
    failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    return failed, not failed and lost <= max_loss * total


def judge(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per document: the base counts, the verdict and the share of text that line cleaning removed."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, removed_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                counts = base_counts(text)
                _, total, lost = clean_text(text)
                rows.append((doc_id, *counts, *verdict(counts[0], counts[4], total, lost, max_loss), lost))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def clean_lines(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The documents that pass, their failing lines removed; columns as given (n_chars follows the text if it is there)."""
    names = docs.columns
    at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, texts = [], []
            for text in b.column(at):
                text = text.as_py()
                n_words, _, _, _, n_repeat = base_counts(text)
                cleaned, total, lost = clean_text(text)
                ok = verdict(n_words, n_repeat, total, lost, max_loss)[1]
                keep.append(ok)
                if ok:
                    texts.append(cleaned if lost else text)
            out = b.filter(pa.array(keep, type=pa.bool_()))
            arrays = list(out.columns)
            arrays[at] = pa.array(texts, type=b.schema.types[at])
            if size_at is not None:
                arrays[size_at] = pa.array([len(t) for t in texts], type=b.schema.types[size_at])
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, r, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
s AS (SELECT r, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS n FROM l),
f AS (
  SELECT r, line, n, n > 0 AND (
    len(regexp_extract_all(s, '[|»›•>]|&gt;')) >= 3 OR len(regexp_extract_all(s, '[#*$%&|<>]')) > 0.2 * n
    OR (len(regexp_extract_all(s, '!')) >= 4 AND NOT regexp_matches(s, '[a-z]')) OR (regexp_matches(s, '(?i)(^|[^\p{L}\p{N}_])(BOILER)([^\p{L}\p{N}_]|$)') AND words <= 20)
    OR (NOT regexp_matches(s, '[ENDS][CLOSERS]*$') AND words + len(regexp_extract_all(s, 'UNSPACED')) // 2 <= 6)) AS fails
  FROM (SELECT *, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS words FROM s)),
c AS (SELECT r, sum(n) AS total, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup FROM f GROUP BY r),
j AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(total AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS removed_chars
  FROM w JOIN c USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_chars <= 0.5 * word_chars AS kept, removed_chars
FROM j
""".replace("BOILER", "|".join(BOILERPLATE).replace("'", "''")).replace("ENDS", END_MARKS).replace("CLOSERS", CLOSERS.replace("'", "''")).replace("UNSPACED", UNSPACED)
