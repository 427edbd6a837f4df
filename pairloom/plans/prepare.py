"""From sources to a training set.

load -> messages to columns -> rename -> concat -> check columns -> system prompt -> dedup ->
first N -> format -> split. Each step is an operator of this package; this module only fixes the
order and which steps apply to training, evaluation and previews.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.templates import RowFormatter, formatter
from pairloom.operators import quality
from pairloom.operators.columns import check_columns, rename, set_system
from pairloom.operators.dedup import deduplicate
from pairloom.operators.messages import convert_messages, has_messages_format
from pairloom.operators.order import ORD, WIDE, Page, head, page_rows
from pairloom.operators.reshape import concat_sources, kto_explode
from pairloom.operators.split import shuffle_rows, split
from pairloom.session import cut_lineage, scratch_path, stage
from pairloom.sources.files import FileTable
from pairloom.sources.read import open_source, read_source
from pairloom.sources.spec import PrepareSpec, SourceSpec


@dataclass(frozen=True)
class Loaded:
    """A table with how its columns map to the standard ones."""

    df: DataFrame
    mapping: Mapping[str, str] | None = None
    convert: bool = True
    files: FileTable | None = None   # the same rows as a table of files: pages and caps open only those they need


class Preparation:
    """A preparation over loaded tables. All methods are lazy up to the counts a split or page needs."""

    def __init__(self, primary: Loaded, spec: PrepareSpec | Mapping[str, Any] | None = None,
                 additional: Sequence[Loaded] = (), evaluation: Loaded | None = None,
                 row_formatter: RowFormatter | None = None, renderer: Any = None, ord: str = ORD):
        self.spec = PrepareSpec.of(spec or {})
        self.primary, self.additional, self.evaluation = primary, tuple(additional), evaluation
        self.renderer, self.ord = renderer, ord
        fmt = self.spec.format
        self.formatter = row_formatter or formatter(
            fmt.format_type, custom_templates=fmt.custom_templates, renderer=renderer,
            enable_thinking=fmt.enable_thinking, auto_detect_thinking=fmt.auto_detect_thinking,
            on_mismatch=fmt.on_mismatch)

    @classmethod
    def from_spec(cls, spark: SparkSession, spec: PrepareSpec | Mapping[str, Any], hub_root: str | None = None,
                  uploads: Mapping[str, str] | None = None, **kw: Any) -> "Preparation":
        """Read every source the spec names.

        The spec's own mapping is for the primary source, and for an evaluation source without one;
        additional sources bring theirs.
        """
        spec = PrepareSpec.of(spec)
        if spec.source is None:
            raise ValueError("the spec names no source")

        def load(source: SourceSpec, mapping: Mapping[str, str] | None) -> Loaded:
            files = None if source.streaming else open_source(spark, source, hub_root, uploads)
            df = files.rows() if files else read_source(spark, source, hub_root, uploads)
            return Loaded(df, mapping, spec.convert_messages_format, files)

        evaluation = None
        if spec.eval_source is not None:
            evaluation = load(spec.eval_source, spec.eval_source.column_mapping or spec.column_mapping)
        return cls(load(spec.source, spec.column_mapping or spec.source.column_mapping), spec,
                   [load(s, s.column_mapping) for s in spec.additional_sources], evaluation, **kw)

    def _converts(self, loaded: Loaded) -> bool:
        return loaded.convert and has_messages_format(loaded.df)

    def _mapped(self, loaded: Loaded, rows: DataFrame | None = None) -> DataFrame:
        """A source, or some of its rows, with the standard columns."""
        df = loaded.df if rows is None else rows
        if self._converts(loaded):
            df = convert_messages(df, self.renderer, self.spec.on_error)
        return rename(df, loaded.mapping)

    def _sources(self) -> tuple[Loaded, ...]:
        return (self.primary, *self.additional)

    def _concatenated(self, rows: Sequence[DataFrame | None] | None = None) -> DataFrame:
        sources = [self._mapped(s, r) for s, r in zip(self._sources(), rows or [None] * len(self._sources()))]
        return concat_sources(sources, self.ord) if len(sources) > 1 else sources[0]

    def _cut(self, size: int, offset: int = 0) -> DataFrame | None:
        """Rows [offset, offset + size) of all sources, from the files that hold them.

        None unless every source is a table of files of which no row is dropped on the way.
        """
        sources, parts, before = self._sources(), [], 0
        if any(s.files is None for s in sources) or self.ord != ORD:
            return None
        if self.spec.on_error == "drop" and any(self._converts(s) for s in sources):
            return None
        size, offset = max(0, size), max(0, offset)
        for s in sources:
            low = max(offset - before, 0)
            parts.append(s.files.slice(low, max(offset + size - before - low, 0)))
            before += s.files.total() if s is not sources[-1] else 0
        return self._concatenated(parts)

    def _with_system(self, df: DataFrame) -> DataFrame:
        return set_system(df, self.spec.system_prompt, self.spec.system_prompt_mode)

    def combined(self) -> DataFrame:
        """All sources mapped and concatenated, system prompt applied; what previews and statistics see."""
        return self._with_system(self._concatenated())

    def formatted(self, df: DataFrame) -> DataFrame:
        return self.formatter(df)

    def cleaned(self) -> DataFrame:
        """Checked training rows with their system prompt, without duplicates where the spec asks for it."""
        df = self._with_system(check_columns(self._concatenated(), self.spec.training_mode))
        if self.spec.deduplicate:
            df = deduplicate(df, self.spec.dedupe_strategy, ord=self.ord, compat=self.spec.compat_keys)
        return df

    def training_rows(self, staged: bool = False) -> tuple[DataFrame, DataFrame]:
        """(rows, ordinals): the capped training rows, not yet formatted, and a table to look their ordinals up in.

        Positions are searched for in several passes. A cap on tables of files reads only the files it needs; staged
        rows are read back from a table; of deduplicated rows the ordinals are written.
        """
        cap, dedup = self.spec.max_samples, self.spec.deduplicate
        cut = self._cut(cap) if cap and not dedup else None
        rows = self.cleaned() if cut is None else self._with_system(check_columns(cut, self.spec.training_mode))
        if staged or cap and cut is None and cap <= WIDE:   # few rows, or all of them, are written at once
            rows = rows if cut is not None or staged else head(rows, cap, self.ord)
            rows = stage(rows, scratch_path(rows.sparkSession, "prepared"))
        ordinals = rows.select(self.ord)
        if dedup and not staged and (cap or self.spec.test_size) and not (cap and cap <= WIDE):
            ordinals = stage(ordinals, scratch_path(rows.sparkSession, "ordinals"))
        if not cap or cut is not None:
            return rows, ordinals
        return head(rows, cap, self.ord, ordinals), head(ordinals, cap, self.ord, ordinals)

    def prepare(self, staged: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """(train, eval). An explicit evaluation set is formatted as it is; else a fraction is held out.

        `staged` writes the cleaned rows to the shared folder first, so that writing both sides reads
        a Parquet table instead of repeating the cleaning. Without it, only the ordinals of
        deduplicated rows are written, to find the split in them.
        """
        rows, ordinals = self.training_rows(staged)
        if self.evaluation is not None:
            held = check_columns(self._mapped(self.evaluation), self.spec.training_mode)
            return self.formatted(rows), self.formatted(self._with_system(held))
        train, held = split(rows, self.spec.test_size, self.spec.seed, self.spec.shuffle, self.ord, ordinals)
        return self.formatted(train), None if held is None else self.formatted(held)

    def prepare_unpaired(self, staged: bool = False, raw_negatives: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """(train, eval) as (prompt, response, label) in seeded random order.

        By default an answer counts as a negative when its formatted text is not blank, which a
        template's closing marker always satisfies; `raw_negatives` tests the text before formatting.
        """
        keep_raw = replace(self.formatter, apply=lambda df, f=self.formatter: f(
            df.withColumn("_rejected", F.col("rejected")) if "rejected" in df.columns else df))
        plan = Preparation(self.primary, self.spec, self.additional, self.evaluation, keep_raw, self.renderer, self.ord)

        def unpaired(df: DataFrame | None) -> DataFrame | None:
            if df is None:
                return None
            source = "rejected" if not raw_negatives else ("_rejected" if "_rejected" in df.columns else None)
            pairs = df if source else df.drop("rejected")
            examples = kto_explode(pairs, source or "rejected", keep=[self.ord])
            return shuffle_rows(examples, self.spec.seed, self.ord, "label").drop(self.ord)

        train, held = plan.prepare(staged)
        return unpaired(train), unpaired(held)

    def preview(self, num_samples: int = 5, offset: int = 0) -> Page:
        """A page of unformatted rows and the total row count; of tables of files only those are opened that hold the page."""
        return self._page(num_samples, offset, lambda df: df)

    def preview_formatted(self, num_samples: int = 5, offset: int = 0) -> Page:
        """A page of formatted rows: only the page is formatted."""
        return self._page(num_samples, offset, lambda df: check_columns(df, self.spec.training_mode), self.formatted)

    def _page(self, size: int, offset: int, check: Callable[[DataFrame], DataFrame],
              show: Callable[[DataFrame], DataFrame] = lambda df: df) -> Page:
        cut = self._cut(size, offset)
        if cut is None:
            df = check(self.combined())
            return Page(show(page_rows(df, size, offset, self.ord)), df.count())
        rows = check(self._with_system(cut)).orderBy(self.ord)
        return Page(show(rows), sum(s.files.total() for s in self._sources()))

    def stats(self, rounded: bool = True) -> dict[str, DataFrame]:
        """Small tables describing the combined rows: overview, fields, balance (with rejected), tokens.

        Lengths are counted in one pass, which fields and tokens share.
        """
        df = self.combined()
        lengths = cut_lineage(quality.length_histogram(df))
        out = {"overview": quality.overview(df, self.spec.training_mode),
               "fields": quality.stats_of(lengths, rounded), "tokens": quality.tokens_of(lengths)}
        if {"chosen", "rejected"} <= set(df.columns):
            out["balance"] = quality.length_balance(df, rounded)
        return out
