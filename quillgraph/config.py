"""Options and their defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .functions.annotate import Options as NoteOptions


@dataclass(frozen=True)
class BuildOptions:
    """How a corpus becomes a memory. A row's own `date` and `title` come from the corpus.

    full: None compares all notes of a document that can be similar; a number compares those of documents with more notes
    by MinHash bands only, which miss some.
    """

    chunk_size: int = 800
    chunk_overlap: int = 100
    min_entity_frequency: int = 1
    min_topic_frequency: int = 1
    stop_words: tuple[str, ...] = ()
    temperature: float = 0.5
    link_top_k: int = 3
    link_threshold: float = 0.3
    verbose_labels: bool = False
    dedupe: bool = False
    dedupe_threshold: float = 0.9
    keep_source: bool = True
    full: int | None = None

    @property
    def notes(self) -> NoteOptions:
        return NoteOptions(self.chunk_size, self.chunk_overlap, self.min_entity_frequency, self.min_topic_frequency, tuple(self.stop_words))


@dataclass(frozen=True)
class RecallOptions:
    top_k: int = 5
    hops: bool = True
    expand: bool = False
    after: str | None = None
    before: str | None = None


@dataclass(frozen=True)
class InjectOptions:
    """format: text, json or markdown; selection: weight or mmr; count_tokens: a function of a string."""

    max_notes: int | None = None
    min_weight: float | None = None
    flags: tuple[str, ...] = ()
    format: str = "text"
    max_tokens: int | None = None
    selection: str = "weight"
    guarantee_flags: tuple[str, ...] = ()
    count_tokens: Callable[[str], int] | None = field(default=None, compare=False)


@dataclass(frozen=True)
class StreamOptions:
    build: BuildOptions = BuildOptions()
    half_life_turns: float | None = None
    max_notes: int | None = None
    date: str | None = None
    title: str | None = None
