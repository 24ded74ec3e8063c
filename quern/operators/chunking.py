"""Chunkers: one pass over a document's text each, run on Arrow batches without a shuffle.

A chunker turns a text into pieces. Pieces are first found as spans of the whitespace-normalised
text, small neighbours are joined, and each piece is then given a tail of the one before as
overlap. Cutting is an inherently sequential fold, so it is plain Python inside ``mapInArrow``;
everything around it (identifiers, hashes, sizes, metadata) is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T

# Separators from the largest unit of meaning to the smallest.
SEPARATORS = ("\n# ", "\n## ", "\n### ", "\n#### ", "\n---", "\n\n", "\n```", "\n- ", "\n* ", "\n1. ", "\n", ". ", "; ", ", ", " ")

# How headings, code fences and the ends of sentences are written.
_HEADING = re.compile(r"(#{1,6})\s+(.+?)$")
_OPENING = re.compile(r"(#{1,6})\s+(.+?)(?:\n|$)")
_FENCE = re.compile(r"```[\s\S]*?```|~~~[\s\S]*?~~~")
_AFTER_SENTENCE = re.compile(r"(?<=[.!?])\s+")
# Fixed value: where the sentence splitter of the semantic chunker may cut.
_BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*(?=\n)|(?<=```)\s*\n|\n(?=#{1,6}\s)|\n(?=[-*]\s)|\n(?=\d+\.\s)")
JOINT = "\n\n"


@dataclass(frozen=True)
class ChunkerConfig:
    """Sizes in estimated tokens (four characters each)."""

    chunk_size: int = 512
    chunk_overlap: int = 50
    min_chunk_size: int = 100
    max_chunk_size: int = 1024
    separators: tuple[str, ...] = SEPARATORS
    preserve_code_blocks: bool = True
    preserve_lists: bool = True
    include_section_headers: bool = True

    def __post_init__(self):
        checks = [
            (self.chunk_size > 0, "a chunk needs a size of one token at least"),
            (self.chunk_overlap >= 0, "an overlap is not below zero"),
            (self.chunk_overlap < self.chunk_size, "the overlap has to be smaller than the chunk"),
            (self.min_chunk_size >= 0, "the smallest size is not below zero"),
            (self.max_chunk_size >= self.chunk_size, "the largest size has to reach the chunk size"),
        ]
        for good, message in checks:
            if not good:
                raise ValueError(message)


@dataclass(frozen=True)
class SemanticConfig(ChunkerConfig):
    similarity_threshold: float = 0.5
    buffer_size: int = 1
    min_sentences_per_chunk: int = 2
    breakpoint_percentile: int | None = None

    def __post_init__(self):
        super().__post_init__()
        if not 0 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold must be between 0 and 1")
        if self.buffer_size < 1:
            raise ValueError("buffer_size must be at least 1")
        if self.breakpoint_percentile is not None and not 1 <= self.breakpoint_percentile <= 99:
            raise ValueError("breakpoint_percentile must be between 1 and 99")


class Span(NamedTuple):
    text: str
    start: int
    end: int


class Piece(NamedTuple):
    """A chunk before it is a row."""

    text: str
    token_count: int
    start: int | None = None
    end: int | None = None
    section_header: str | None = None
    has_code_block: bool = False
    is_summary_chunk: bool = False


# ---------------------------------------------------------------- shared steps


def estimate(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" +", " ", text)).strip()


def opening_header(text: str) -> str | None:
    found = _OPENING.match(text)
    return found[2].strip() if found else None


def ranges(pattern: str, text: str, group: int = 0) -> list[tuple[int, int]]:
    return [m.span(group) for m in re.finditer(pattern, text)]


def code_ranges(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _FENCE.finditer(text)]


# Lists are blocks of lines that start with a number and a dot, or with a dash or an asterisk.
def numbered_ranges(text: str) -> list[tuple[int, int]]:
    return ranges(r"(?:^|\n)((?:\d+\.\s+.+\n?)+)", text, 1)


def bullet_ranges(text: str) -> list[tuple[int, int]]:
    return ranges(r"(?:^|\n)((?:[-*]\s+.+\n?)+)", text, 1)


def _last_units(units: Sequence[str], room: int, joint: str) -> str:
    """The longest run of last units that fits the room, one unit at least."""
    size, first = 0, len(units)
    while first > 0 and (first == len(units) or size + len(units[first - 1]) <= room):
        first -= 1
        size += len(units[first]) + 1
    return joint.join(units[first:])


def overlap_tail(text: str, overlap_tokens: int) -> str:
    """What the next chunk repeats of this one: last sentences, else last lines, else a tail cut at a word."""
    room = overlap_tokens * 4
    if not text or room <= 0:
        return ""
    if len(text) <= room:
        return text
    region = text[-2 * room :]
    for units, joint in ((_AFTER_SENTENCE.split(region), " "), (region.split("\n"), "\n")):
        if len(units) > 1:
            return _last_units(units, room, joint)
    tail = text[-room:]
    blank = tail.find(" ")
    return tail[blank + 1 :] if 0 < blank < len(tail) // 3 else tail


def join_small(spans: Iterable[Span], low: int, high: int) -> list[Span]:
    """Join neighbours left to right while one is below ``low`` and both together fit ``high``; a heading waits for what follows it."""
    out: list[Span] = []
    for span in spans:
        if out:
            last = out[-1]
            both = last.text + JOINT + span.text
            wants = estimate(last.text) < low or (estimate(span.text) < low and not re.match(r"#{1,6}\s+", span.text.lstrip()))
            if wants and estimate(both) <= high:
                out[-1] = Span(both, last.start, span.end)
                continue
        out.append(span)
    return out


def with_overlap(spans: Sequence[Span], overlap: int, skip_if_there: bool = False) -> Iterator[tuple[Span, str]]:
    """Each span with the text of its chunk: the overlap of the span before, a blank line, the span."""
    before = ""
    for span in spans:
        tail = overlap_tail(before, overlap) if before and overlap > 0 else ""
        there = skip_if_there and span.text.startswith(tail[:20])
        yield span, tail + JOINT + span.text if tail and not there else span.text
        before = span.text


# ---------------------------------------------------------------- recursive


def _cuts(text: str, a: int, b: int, separator: str) -> list[tuple[int, int]]:
    """Ranges of text[a:b] that start at its separators."""
    marks, at = [a], text.find(separator, a, b)
    while at != -1:
        if at > marks[-1]:
            marks.append(at)
        at = text.find(separator, at + len(separator), b)
    return list(zip(marks, [*marks[1:], b], strict=True))


def _narrow(text: str, a: int, b: int, separators: Sequence[str], size: int) -> Iterator[Span]:
    """Spans of at most ``size`` characters: cut at the first separator that occurs, and what is too long at the next ones."""
    if not text[a:b].strip():
        return
    if b - a <= size:
        yield Span(text[a:b], a, b)
        return
    for k, separator in enumerate(separators):
        if text.find(separator, a, b) != -1:
            for x, y in _cuts(text, a, b, separator):
                yield from _narrow(text, x, y, separators[k + 1 :], size)
            return
    while b - a > size:  # nothing to cut at: a blank in the last fifty characters, or anywhere
        blank = text.rfind(" ", a + max(0, size - 50), a + size)
        stop = blank + 1 if blank > a + max(0, size - 50) else a + size
        yield Span(text[a:stop], a, stop)
        a = stop
    if b > a:
        yield Span(text[a:b], a, b)


def recursive(text: str, config: ChunkerConfig = ChunkerConfig()) -> list[Piece]:
    """Cut at the largest separators that make pieces small enough."""
    whole = tidy(_given(text))
    spans = join_small(_narrow(whole, 0, len(whole), config.separators, config.chunk_size * 4), config.min_chunk_size, config.max_chunk_size)
    return [Piece(t.strip(), estimate(t), s.start, s.end) for s, t in with_overlap(spans, config.chunk_overlap)]


def _given(text: str) -> str:
    if not text or not text.strip():
        raise ValueError("there is no text to cut: it is empty")
    return text


# ---------------------------------------------------------------- by structure


class Section(NamedTuple):
    header: str
    level: int
    content: str
    start: int
    end: int

    @property
    def prefix(self) -> str:
        return f"{'#' * self.level} {self.header}\n\n" if self.header else ""


def sections(text: str) -> list[Section]:
    """Runs of lines under each heading line; headings inside code fences count too."""
    lines = text.split("\n")
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line) + 1)
    heads = [(i, m[2].strip(), len(m[1])) for i, line in enumerate(lines) if (m := _HEADING.match(line))]
    marks = [(-1, "", 0), *heads, (len(lines), "", 0)]
    out = []
    for (i, header, level), (j, _, _) in zip(marks, marks[1:], strict=False):
        if i >= 0 or j > 0:  # nothing precedes a heading on the first line
            body = "\n".join(lines[i + 1 : j]).strip()
            out.append(Section(header, level, body, at[max(i, 0)], min(at[j], len(text))))
    return out


def paragraphs(text: str) -> list[str]:
    """Paragraphs between blank lines; a code fence is one."""
    out, at = [], 0
    for a, b in [*code_ranges(text), (len(text), len(text))]:
        out += [p.strip() for p in text[at:a].split(JOINT) if p.strip()]
        if b > a:
            out.append(text[a:b])
        at = b
    return out


def _fill(units: Iterable[str], prefix: str, glue: str, size: int, keep_bare: bool, on_start: Callable[[str], list[str] | None] = lambda u: None) -> Iterator[str]:
    """Pack units behind a prefix into texts of at most ``size``; ``on_start`` may break up a unit that starts a text."""
    now = prefix
    bare = {""} if keep_bare else {"", prefix.strip()}
    for unit in units:
        if len(now) + len(unit) + len(glue) <= size:
            now += unit + glue
            continue
        if now.strip() not in bare:
            yield now.strip()
        broken = on_start(unit)
        if broken is None:
            now = prefix + unit + glue
        else:
            yield from broken
            now = prefix
    if now.strip() not in bare:
        yield now.strip()


def _section_texts(section: Section, config: ChunkerConfig) -> list[str]:
    size, most = config.chunk_size * 4, config.max_chunk_size * 4
    whole = section.prefix + section.content
    if len(whole) <= size:
        return [whole]
    prefix = section.prefix if config.include_section_headers else ""

    def break_up(paragraph: str) -> list[str] | None:
        if len(prefix) + len(paragraph) + len(JOINT) <= most:
            return None
        return list(_fill(_AFTER_SENTENCE.split(paragraph), prefix, " ", size, keep_bare=False))

    return list(_fill(paragraphs(section.content), prefix, JOINT, size, keep_bare=True, on_start=break_up))


def by_structure(text: str, config: ChunkerConfig = ChunkerConfig()) -> list[Piece]:
    """Sections by headings; long ones by paragraphs (fences whole, heading repeated), then by sentences."""
    whole = tidy(_given(text))
    spans = [Span(t, s.start, s.end) for s in sections(whole) for t in _section_texts(s, config)]
    spans = join_small(spans, config.min_chunk_size, config.max_chunk_size)
    return [
        Piece(t.strip(), estimate(t), s.start, s.end, opening_header(s.text), "```" in s.text or "~~~" in s.text, k == 0)
        for k, (s, t) in enumerate(with_overlap(spans, config.chunk_overlap, skip_if_there=True))
    ]


# ---------------------------------------------------------------- issues and threads


def issue(title: str | None, body: str | None, config: ChunkerConfig = ChunkerConfig(), code_in_body: bool = False) -> list[Piece]:
    """An issue: its title with the first paragraph as the summary chunk, the rest by structure."""
    if not title and not body:
        raise ValueError("an issue needs a title or a body; both are empty")
    head = f"# {title}" if title else ""
    summary = lambda t, end: Piece(t.strip(), estimate(t), 0, end, None, code_in_body, True)
    if not body or not body.strip():
        if not head.strip():
            raise ValueError("the issue is empty but for blanks")
        return [summary(head, len(head))]
    first, _, rest = tidy(body).partition(JOINT)
    size, both = config.chunk_size * 4, f"{head}{JOINT}{first}" if head else first
    if len(both) <= size:
        out = [summary(both, len(both))]
    else:
        out = [summary(head or first[:size], len(title) if title else size)]
        rest = first + JOINT + rest if rest else first
    return out + (by_structure(rest, config) if rest.strip() else [])


class Comment(NamedTuple):
    author: str
    body: str
    comment_id: str | None = None
    created_at: str | None = None


# What stands between merged comments, and the line that heads a comment's chunks.
COMMENT_JOINT, COMMENT_HEAD = "\n\n---\n\n", "**Comment by @{author}:**\n\n"


def merge_comments(comments: Sequence[Comment], most_chars: int) -> list[Comment]:
    """Join an author's consecutive comments under the first one's id while they stay within the cap."""
    out: list[Comment] = []
    for c in comments:
        if out and out[-1].author == c.author and len(out[-1].body) + len(c.body) + 10 <= most_chars:
            out[-1] = out[-1]._replace(body=out[-1].body + COMMENT_JOINT + c.body)
        else:
            out.append(c)
    return out


def thread(comments: Sequence[Comment], config: ChunkerConfig = ChunkerConfig(), merge_same_author: bool = True) -> list[tuple[Comment, Piece]]:
    """Chunks of a comment thread, each headed by its author, with the comment it comes from."""
    merged = merge_comments(comments, config.max_chunk_size * 4) if merge_same_author else list(comments)
    out = []
    for c in merged:
        head = COMMENT_HEAD.format(author=c.author)
        texts = [head + c.body] if len(head) + len(c.body) <= config.chunk_size * 4 else [head + p.text for p in by_structure(c.body, config)]
        out += [(c, Piece(t.strip(), estimate(t), None, None, f"Comment by @{c.author}", "```" in c.body, False)) for t in texts]
    return out


# ---------------------------------------------------------------- semantic and hybrid

Embed = Callable[[list[str]], np.ndarray]


def sentences(text: str) -> list[Span]:
    """Sentences, headings and list items with their places."""
    marks = [(0, 0), *(m.span() for m in _BOUNDARY.finditer(text)), (len(text), len(text))]
    out = [Span(t, a, b) for (_, a), (b, _) in zip(marks, marks[1:], strict=False) if b > a and (t := text[a:b].strip())]
    return out


def _grouped(found: Sequence[Span], after: set[int]) -> list[Span]:
    out, first = [], 0
    for k in range(len(found)):
        if k in after or k == len(found) - 1:
            out.append(Span(" ".join(s.text for s in found[first : k + 1]), found[first].start, found[k].end))
            first = k + 1
    return out


def neighbourhoods(texts: Sequence[str], width: int) -> list[str]:
    """Each text with ``width - 1`` neighbours on either side."""
    return [" ".join(texts[max(0, k - width + 1) : k + width]) for k in range(len(texts))]


def cosines(vectors: np.ndarray) -> np.ndarray:
    """Similarity of each vector with the next."""
    size = np.linalg.norm(vectors, axis=1)
    product = size[:-1] * size[1:]
    dots = np.einsum("ij,ij->i", vectors[:-1], vectors[1:])
    return np.divide(dots, product, out=np.zeros_like(product), where=product > 0)


def breakpoints(similar: Sequence[float], config: SemanticConfig) -> set[int]:
    """Places whose similarity is below the threshold, at least the minimum number of sentences apart."""
    cut = config.similarity_threshold if config.breakpoint_percentile is None else float(np.percentile(similar, config.breakpoint_percentile))
    out, last = set(), -1
    for k, value in enumerate(similar):
        if value < cut and k - last >= config.min_sentences_per_chunk:
            out.add(k)
            last = k
    return out


def semantic(text: str, config: SemanticConfig = SemanticConfig(), embed: Embed | None = None) -> list[Piece]:
    """Cut where neighbouring sentences differ most in meaning; without an embedder, pack sentences to the chunk size."""
    whole = tidy(_given(text))
    found = sentences(whole)
    if embed is None and found:
        after, size = set(), 0
        for k, s in enumerate(found):
            if size and size + estimate(s.text) > config.chunk_size:
                after.add(k - 1)
                size = 0
            size += estimate(s.text)
        spans = _grouped(found, after)
    elif embed is None or len(found) < 3:
        return [Piece(whole.strip(), estimate(whole), 0, len(whole))]
    else:
        vectors = np.asarray(embed(neighbourhoods([s.text for s in found], config.buffer_size)), float)
        spans = _grouped(found, breakpoints(cosines(vectors), config))
        spans = join_small(spans, config.min_chunk_size, config.max_chunk_size)
    return [Piece(t.strip(), estimate(t), s.start, s.end) for s, t in with_overlap(spans, config.chunk_overlap)]


def well_structured(text: str) -> bool:
    """Two headings at least, one for every ten paragraphs at least, and less than 70 % code."""
    headers = len(re.findall(r"^#{1,6}\s+.+$", text, re.MULTILINE))
    blocks = sum(1 for p in re.split(r"\n\n+", text) if p.strip())
    code = sum(b - a for a, b in code_ranges(text))
    return headers >= 2 and headers / max(blocks, 1) > 0.1 and code < 0.7 * len(text)


def hybrid(text: str, config: ChunkerConfig = ChunkerConfig()) -> list[Piece]:
    return (by_structure if well_structured(_given(text)) else recursive)(text, config)


# ---------------------------------------------------------------- registry


@dataclass
class Registry:
    """Chunkers by strategy name and, for each source type, the strategy used."""

    strategies: dict[str, Callable] = field(
        default_factory=lambda: {"recursive": recursive, "structure_aware": by_structure, "github_issue": by_structure, "semantic": semantic, "hybrid": hybrid}
    )
    sources: dict[str, str] = field(default_factory=lambda: {"github_issue": "github_issue", "github_issue_comment": "github_issue", "markdown_doc": "hybrid"})
    default: str = "recursive"

    def register(self, source: str, strategy: str, chunker: Callable | None = None) -> None:
        if chunker is not None:
            self.strategies[strategy] = chunker
        self.get(strategy)
        self.sources[source] = strategy

    def get(self, strategy: str) -> Callable:
        if strategy not in self.strategies:
            raise ValueError(f"Unknown strategy '{strategy}'. Available: {', '.join(self.strategies)}")
        return self.strategies[strategy]

    def strategy_for(self, source: str | None) -> str:
        return self.sources.get(source or "", self.default)


REGISTRY = Registry()

# ---------------------------------------------------------------- over DataFrames

_PIECE = "chunk_index int, chunk_text string, token_count int, start_char_offset int, end_char_offset int, section_header string, has_code_block boolean, is_summary_chunk boolean, strategy string, error string"
_ARROW = pa.schema(
    [("chunk_index", pa.int32()), ("chunk_text", pa.string()), ("token_count", pa.int32()), ("start_char_offset", pa.int32()), ("end_char_offset", pa.int32())]
    + [("section_header", pa.string()), ("has_code_block", pa.bool_()), ("is_summary_chunk", pa.bool_()), ("strategy", pa.string()), ("error", pa.string())]
)


def _named(name: str, text: str) -> str:
    """The hybrid strategy names its choice."""
    return name if name != "hybrid" else "hybrid:structure_aware" if well_structured(text) else "hybrid:recursive"


def chunk_documents(
    docs: DataFrame,
    strategy: str | None = None,
    config: ChunkerConfig | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = None,
    title_col: str | None = None,
    registry: Registry = REGISTRY,
    embed: Embed | None = None,
) -> DataFrame:
    """Chunk every document: its columns but the text, then the chunk's.

    The strategy is given or follows from the source column. Titled issues get the issue chunker.
    ``embed``, which runs on the executors, lets the semantic strategy see meaning. A document that cannot be chunked is one row with ``error`` set. ``chunk_id`` follows from
    document id, index and hash.
    """
    keep = [c for c in docs.columns if c not in (text_col, *_ARROW.names, "chunk_hash", "chunk_id", "char_count")]
    if id_col not in keep:
        keep.insert(0, id_col)
    extra = {"__text": F.col(text_col), "__source": F.col(source_col) if source_col else F.lit(None).cast("string"), "__title": F.col(title_col) if title_col else F.lit(None).cast("string")}
    rows, given = docs.select(*keep, *(c.cast("string").alias(n) for n, c in extra.items())), tuple(extra)

    def pieces(text: str | None, source: str | None, title: str | None) -> list[tuple]:
        name = strategy or registry.strategy_for(source)
        try:
            if not text:
                raise ValueError("the document has no text")
            chunker = registry.get(name)
            used = config or (SemanticConfig() if name == "semantic" else ChunkerConfig())
            found = issue(title, text, used) if source == "github_issue" and title and name == "github_issue" else chunker(text, used, embed) if name == "semantic" else chunker(text, used)
            return [(k, *p, _named(name, text), None) for k, p in enumerate(found)]
        except ValueError as problem:
            return [(None, None, None, None, None, None, None, None, name, str(problem))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, owner = [], []
            for k, args in enumerate(zip(*(batch.column(n).to_pylist() for n in given), strict=True)):
                found = pieces(*args)
                made += found
                owner += [k] * len(found)
            columns = list(zip(*made, strict=True)) or [[] for _ in _ARROW]
            kept = batch.select(keep).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True))], [*keep, *_ARROW.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    chunks = rows.mapInArrow(run, f"{kinds}, {_PIECE}")
    chunks = chunks.withColumn("char_count", F.length("chunk_text")).withColumn("chunk_hash", F.when(F.col("chunk_text").isNotNull(), F.sha2("chunk_text", 256)))
    return chunks.withColumn("chunk_id", F.when(F.col("chunk_text").isNotNull(), T.chunk_id(F.col(id_col).cast("string"), F.col("chunk_index"), F.col("chunk_hash"))))


def chunk_threads(
    turns: DataFrame,
    config: ChunkerConfig = ChunkerConfig(),
    thread_col: str = "conv_id",
    order_col: str = "turn",
    author_col: str = "role",
    body_col: str = "text",
    merge_same_author: bool = True,
) -> DataFrame:
    """Chunks of comment threads: thread, chunk_index, comment_id (the order value of its first comment), author, text and sizes.

    Threads are brought together by one shuffle on the thread and streamed: only the comment being
    merged and its chunks are held.
    """
    rows = turns.select(F.col(thread_col).alias("thread"), F.col(order_col).cast("string").alias("at"), F.col(order_col).alias("__order"), F.col(author_col).cast("string").alias("author"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.repartition("thread").sortWithinPartitions("thread", "__order", "author", "body").drop("__order")
    kind = rows.schema["thread"].dataType.simpleString()
    names = ["thread", "chunk_index", "comment_id", "author", "chunk_text", "token_count", "has_code_block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Comment | None = None
        key, index = object(), 0
        for batch in batches:
            out: list[tuple] = []
            thread_type = batch.schema.field("thread").type

            def flush() -> None:
                nonlocal index
                for c, p in thread([held], config, False) if held is not None else ():
                    out.append((key, index, c.comment_id, c.author, p.text, p.token_count, p.has_code_block))
                    index += 1

            for k, at, author, body in zip(*(batch.column(n).to_pylist() for n in ("thread", "at", "author", "body")), strict=True):
                new = Comment(author, body, at)
                if held is not None and k == key and merge_same_author and len(both := merge_comments([held, new], config.max_chunk_size * 4)) == 1:
                    held = both[0]
                    continue
                flush()
                if k != key:
                    key, index = k, 0
                held = new
            yield _thread_rows(out, names, thread_type)
        if held is not None:
            out = []
            for c, p in thread([held], config, False):
                out.append((key, index, c.comment_id, c.author, p.text, p.token_count, p.has_code_block))
                index += 1
            yield _thread_rows(out, names, thread_type)

    return rows.mapInArrow(run, f"thread {kind}, chunk_index int, comment_id string, author string, chunk_text string, token_count int, has_code_block boolean").withColumnRenamed("thread", thread_col)


def _thread_rows(rows: list[tuple], names: list[str], thread_type: pa.DataType) -> pa.RecordBatch:
    kinds = [thread_type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def summarize(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks, tokens and characters of each document."""
    good = chunks.where(F.col("chunk_text").isNotNull())
    return good.groupBy(id_col).agg(F.count(F.lit(1)).alias("total_chunks"), F.sum("token_count").alias("total_tokens"), F.sum("char_count").alias("total_chars"))




class ChunkText:
    """The chunkers as a table function: ``chunk_text(text, strategy, chunk_size, chunk_overlap)`` gives (chunk_index, chunk_text, token_count, section_header)."""

    def eval(self, text: str, strategy: str, chunk_size: int, chunk_overlap: int):
        if text and text.strip():
            config = ChunkerConfig(chunk_size, chunk_overlap, min(100, chunk_size), 2 * chunk_size)
            for k, p in enumerate(REGISTRY.get(strategy)(text, config)):
                yield k, p.text, p.token_count, p.section_header


def register_sql(spark: SparkSession, name: str = "chunk_text") -> None:
    """Make the chunkers callable from SQL: ``SELECT ... FROM docs, LATERAL chunk_text(text, 'recursive', 512, 50)``."""
    spark.udtf.register(name, F.udtf(ChunkText, returnType="chunk_index int, chunk_text string, token_count int, section_header string"))
