"""What to read and how to prepare it, as plain dataclasses checked on construction."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import PurePosixPath
from typing import Any

from pairloom.operators.columns import PAIRED_MODES, UNPAIRED_MODES

# File endings and the reader each one means.
FORMAT_BY_ENDING = {".json": "json", ".jsonl": "json", ".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}
FILE_FORMATS = ("json", "jsonl", "csv", "parquet")
SOURCE_TYPES = ("huggingface", "local_file", "upload")
SYSTEM_MODES = ("fill_empty", "replace_all")


class SpecError(ValueError):
    """A source or a preparation is described incompletely or contradictorily."""


def infer_format(path: str, file_format: str | None = None) -> str:
    """The reader for a path: the given format, else by its ending, ignoring case."""
    if file_format:
        if file_format not in FILE_FORMATS:
            raise SpecError(f"unsupported file format {file_format!r}: use one of {FILE_FORMATS}")
        return file_format
    ending = PurePosixPath(path).suffix.lower()
    if ending not in FORMAT_BY_ENDING:
        raise SpecError(f"no format known for ending {ending!r}: name one of {FILE_FORMATS}")
    return FORMAT_BY_ENDING[ending]


def _from_mapping(cls, values: Mapping[str, Any]):
    known = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in values.items() if k in known})


@dataclass(frozen=True)
class SourceSpec:
    """One table to read: a named dataset, a file, or an upload that has landed as a file."""

    source_type: str
    repo_id: str | None = None
    split: str = "train"
    config_name: str | None = None
    file_path: str | None = None
    file_format: str | None = None
    dataset_id: str | None = None
    streaming: bool = False
    streaming_batch_size: int = 10_000
    column_mapping: Mapping[str, str] | None = None
    schema: str | None = None                                   # DDL; saves the inference pass over text files
    options: Mapping[str, Any] = field(default_factory=dict)    # reader options, such as multiLine=False for CSV
    on_error: str = "fail"                                      # fail, drop or quarantine text that does not parse

    def __post_init__(self):
        needs = {"huggingface": "repo_id", "local_file": "file_path", "upload": "dataset_id"}
        if self.source_type not in needs:
            raise SpecError(f"unknown source type {self.source_type!r}: use one of {SOURCE_TYPES}")
        if not getattr(self, needs[self.source_type]):
            raise SpecError(f"a {self.source_type} source needs {needs[self.source_type]}")
        if not 100 <= self.streaming_batch_size <= 100_000:
            raise SpecError("streaming_batch_size must be between 100 and 100000")
        if self.source_type == "local_file":
            infer_format(self.file_path, self.file_format)

    @classmethod
    def of(cls, values: "SourceSpec | Mapping[str, Any]") -> "SourceSpec":
        return values if isinstance(values, cls) else _from_mapping(cls, values)

    def describe(self) -> dict[str, Any]:
        """What identifies the source, for logs and lineage."""
        if self.source_type == "local_file":
            return {"source_type": self.source_type, "file_path": self.file_path,
                    "file_format": infer_format(self.file_path, self.file_format)}
        if self.source_type == "upload":
            return {"source_type": self.source_type, "dataset_id": self.dataset_id, "file_format": self.file_format}
        out = {"source_type": self.source_type, "repo_id": self.repo_id, "split": self.split,
               "config_name": self.config_name or None}
        if self.streaming:
            out |= {"streaming": True, "batch_size": self.streaming_batch_size}
        return out


@dataclass(frozen=True)
class FormatSpec:
    """Which chat template to apply."""

    format_type: str = "chatml"
    custom_templates: Mapping[str, str] | None = None
    enable_thinking: bool | None = True
    auto_detect_thinking: bool = True
    on_mismatch: str = "slice"


@dataclass(frozen=True)
class PrepareSpec:
    """A whole preparation: sources, cleaning, formatting, split."""

    source: SourceSpec | Mapping[str, Any] | None = None
    additional_sources: tuple = ()
    eval_source: SourceSpec | Mapping[str, Any] | None = None
    format: FormatSpec | Mapping[str, Any] = field(default_factory=FormatSpec)
    column_mapping: Mapping[str, str] | None = None
    convert_messages_format: bool = True
    deduplicate: bool = False
    dedupe_strategy: str = "prompt_chosen"
    test_size: float = 0.01
    max_samples: int | None = None
    system_prompt: str | None = None
    system_prompt_mode: str = "fill_empty"
    training_mode: str = "orpo"
    seed: int = 42
    shuffle: bool = True
    on_error: str = "fail"
    compat_keys: bool = False

    def __post_init__(self):
        def put(name: str, value: Any) -> None:
            object.__setattr__(self, name, value)

        for name in ("source", "eval_source"):
            if getattr(self, name) is not None:
                put(name, SourceSpec.of(getattr(self, name)))
        put("additional_sources", tuple(SourceSpec.of(s) for s in self.additional_sources))
        if not isinstance(self.format, FormatSpec):
            put("format", _from_mapping(FormatSpec, self.format))
        put("training_mode", self.training_mode.lower())
        if self.training_mode not in (*PAIRED_MODES, *UNPAIRED_MODES):
            raise SpecError(f"unknown training mode {self.training_mode!r}")
        if self.test_size and not 0.001 <= self.test_size <= 0.5:
            raise SpecError("test_size must be 0 or between 0.001 and 0.5")
        if self.system_prompt_mode not in SYSTEM_MODES:
            raise SpecError(f"system_prompt_mode must be one of {SYSTEM_MODES}")

    @classmethod
    def of(cls, values: "PrepareSpec | Mapping[str, Any]") -> "PrepareSpec":
        return values if isinstance(values, cls) else _from_mapping(cls, values)
