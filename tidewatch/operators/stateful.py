"""Runs a reducer over readings: in batch over sorted partitions, or in a stream with checkpointed state.

A topic's rows are order-dependent, so they meet in one task; they pass through it in batches and only
the reducer's state is held."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.shipping import ship


def output_schema(df: DataFrame, fields: str) -> T.StructType:
    return T.StructType([*df.select("topic", "ts", "seq").schema.fields, *T.StructType.fromDDL(fields).fields])


def run_batch(readings: DataFrame, make: Callable[[], object], column: str | list[str] = "value", together: bool = False) -> DataFrame:
    """(topic, ts, seq) with the reducer's outputs, one row for each reading; a null topic is a topic.

    column: what step() takes, or several in turn. together: one reducer for the rows of all topics in order of time, which
    then are one task's work, as their order is one series."""
    fields = make().FIELDS
    schema = output_schema(readings, fields)
    arrow = to_arrow_schema(schema)
    columns = [column] if isinstance(column, str) else list(column)
    names = [f"_x{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topic, reducer, started = None, None, False
        for b in batches:
            out = []
            for t, *x in zip(b.column("topic").to_pylist(), *[b.column(c).to_pylist() for c in names], strict=True):
                if not started or (t != topic and not together):
                    topic, reducer, started = t, make(), True
                out.append(reducer.step(*x))
            cols = list(zip(*out, strict=True)) if out else [[] for _ in arrow.names[3:]]
            yield pa.RecordBatch.from_arrays([b.column("topic"), b.column("ts"), b.column("seq"), *[pa.array(c, arrow.field(3 + i).type) for i, c in enumerate(cols)]], names=arrow.names)

    ship(readings.sparkSession)
    rows = readings.select("topic", "ts", "seq", *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    rows = rows.repartition(1).sortWithinPartitions("ts", "seq", "topic") if together else rows.repartition("topic").sortWithinPartitions("topic", "ts", "seq")
    return rows.mapInArrow(run, schema)


LATE = "late_rows long"


class ReducerProcessor(StatefulProcessor):
    """A reducer per topic, pickled in the state store after each micro-batch, with its last (ts, seq) and number of late rows."""

    def __init__(self, make: Callable[[], object], columns: list[str], names: list[str], drop_late: bool):
        self.make, self.columns, self.names, self.drop_late = make, columns, names, drop_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reducer", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        reducer, last, late = pickle.loads(self.state.get()[0]) if self.state.exists() else (self.make(), None, 0)
        got = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        if self.drop_late and last is not None:
            fresh = [(t, s) > last for t, s in zip(got["ts"], got["seq"], strict=True)]
            late += len(fresh) - sum(fresh)
            got = got[fresh]
        if len(got):
            last = (got["ts"].iloc[-1], got["seq"].iloc[-1])
        plain = lambda x: None if pd.isna(x) else float(x)
        out = [reducer.step(*map(plain, x)) for x in zip(*[got[c] for c in self.columns], strict=True)]
        self.state.update((pickle.dumps((reducer, last, late)),))
        frame = got[["topic", "ts", "seq"]].reset_index(drop=True)
        made = pd.concat([frame, pd.DataFrame(out, columns=self.names)], axis=1)
        yield made.assign(late_rows=late) if self.drop_late else made

    def close(self) -> None:
        pass


def run_stream(readings: DataFrame, make: Callable[[], object], column: str | list[str] = "value", drop_late: bool = False) -> DataFrame:
    """As run_batch, for a stream of readings; rows of a micro-batch are put in order, later ones follow.

    drop_late: rows that are not after all those of their topic that have been processed are left out, and every row tells in
    late_rows how many that were so far. Otherwise they follow in the order in which they come."""
    fields = make().FIELDS + (f", {LATE}" if drop_late else "")
    ship(readings.sparkSession)
    columns = [column] if isinstance(column, str) else list(column)
    processor = ReducerProcessor(make, columns, T.StructType.fromDDL(make().FIELDS).names, drop_late)
    return readings.groupBy("topic").transformWithStateInPandas(processor, output_schema(readings, fields), "Append", "none")


class Observers:
    """Functions of readings that all get the same readings, by name; an observer that comes later can take what one before has made.

    An observer is a function of (readings, made so far by name). Order of registration is the order of calls."""

    def __init__(self):
        self.by_name: dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]] = {}

    def add(self, name: str, observer: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]) -> None:
        self.by_name[name] = observer

    def remove(self, name: str) -> None:
        del self.by_name[name]

    def run(self, readings: DataFrame) -> dict[str, DataFrame]:
        made: dict[str, DataFrame] = {}
        for name, observer in self.by_name.items():
            made[name] = observer(readings, made)
        return made
