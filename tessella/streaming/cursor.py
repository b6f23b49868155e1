"""A resumable stream of Parquet documents whose offset is (artifact, row), and a packer with residual state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Version of a cursor's format.
CURSOR_VERSION = 1


@dataclass
class _Slice(InputPartition):
    artifact: int
    first: int
    last: int


class CorpusSource(DataSource):
    """``corpus``: options ``files`` (a JSON list of Parquet paths in artifact order), ``columns`` and ``names`` (JSON lists), ``fingerprint``, ``seed`` and ``rows`` a task.

    An offset is a cursor: its format's version, the place of the next row, and what it is bound to: fingerprint, seed and
    the data sets' names in order. A cursor of anything else is refused. ``complete`` marks the terminal one.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return "artifact long, row long, " + ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        import pyarrow.parquet as pq

        self.files, self.columns = json.loads(options["files"]), json.loads(options["columns"])
        self.bound = {"version": CURSOR_VERSION, "fingerprint": options.get("fingerprint", ""), "seed": int(options.get("seed", 0)), "names": json.loads(options.get("names", "[]"))}
        self.rows = int(options.get("rows", 1000))
        self.sizes = [pq.ParquetFile(f).metadata.num_rows for f in self.files]

    def _offset(self, artifact: int, row: int) -> dict:
        while artifact < len(self.sizes) and row >= self.sizes[artifact]:
            artifact, row = artifact + 1, 0
        return {"artifact": artifact, "row": row, "complete": artifact >= len(self.sizes), **self.bound}

    def _check(self, offset: dict) -> dict:
        if wrong := [k for k, v in self.bound.items() if offset.get(k) != v]:
            raise ValueError(f"the cursor belongs to another stream: {', '.join(wrong)}")
        return offset

    def initialOffset(self) -> dict:
        return self._offset(0, 0)

    def latestOffset(self) -> dict:
        return self._offset(len(self.sizes), 0)

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        """Slices of at most ``rows`` rows between two cursors."""
        self._check(start), self._check(end)
        out = []
        for a in range(start["artifact"], min(end["artifact"] + 1, len(self.sizes))):
            first = start["row"] if a == start["artifact"] else 0
            last = end["row"] if a == end["artifact"] else self.sizes[a]
            out += [_Slice(a, at, min(at + self.rows, last)) for at in range(first, last, self.rows)]
        return out

    def read(self, part: _Slice) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        file, at = pq.ParquetFile(self.files[part.artifact]), 0
        for group in range(file.num_row_groups):
            n = file.metadata.row_group(group).num_rows
            if at + n > part.first and at < part.last:  # groups outside the slice aren't read
                table = file.read_row_group(group, columns=self.columns)
                low, high = max(part.first - at, 0), min(part.last - at, n)
                for k, row in enumerate(zip(*[table.column(c).slice(low, high - low).to_pylist() for c in self.columns], strict=True)):
                    yield (part.artifact, at + low + k, *[None if x is None else str(x) for x in row])
            at += n

    def commit(self, end: dict) -> None:
        pass


def corpus_stream(spark: SparkSession, files: list[str], columns: list[str], fingerprint: str = "", rows: int = 1000, seed: int = 0, names: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(CorpusSource)
    options = {"files": json.dumps(files), "columns": json.dumps(columns), "fingerprint": fingerprint, "rows": rows, "seed": seed, "names": json.dumps(names or [])}
    return spark.readStream.format("corpus").options(**options).load()


PACKED = "stream string, window_id long, window_tokens int, target_tokens int, source string, source_targets int"


def pack_stream(df: DataFrame, width: int, stream: str = "stream", order: str = "position", source: str = "source", length: str = "n_tokens") -> DataFrame:
    """Windows of each stream of documents, with the targets of each source; what is left over waits in the state.

    A row a window and source. Within a batch documents are taken in ``order``; batches
    come in order. The state holds the open window's runs: less than a window. Documents
    without a length or without tokens fill nothing.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, runs = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        rows, held = [], sum(n for _, n in runs)

        def out():
            return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

        for name, n in pd.concat(list(pdfs)).sort_values("o")[["s", "n"]].itertuples(index=False):
            runs.append([name, int(n)])
            held += int(n)
            while held >= width:
                credit: dict[str, int] = {}
                left, at, k = width, 0, 0
                while left:
                    take = min(left, runs[k][1])
                    credit[runs[k][0]] = credit.get(runs[k][0], 0) + take - (1 if at == 0 else 0)
                    at, left = at + take, left - take
                    runs[k][1] -= take
                    last, k = k, k + (runs[k][1] == 0)
                runs[last][1] += 1  # the last token opens the next window
                held -= width - 1
                del runs[:last]
                rows += [(key[0], done, width, width - 1, s, t) for s, t in credit.items() if t]
                done += 1
            if len(rows) >= 100_000:
                yield out()
                rows = []
        state.update((done, json.dumps(runs)))
        yield out()

    rows = df.select(F.col(stream).alias("k"), F.col(order).alias("o"), F.col(source).alias("s"), F.col(length).cast("long").alias("n")).where("n > 0")
    return rows.groupBy("k").applyInPandasWithState(step, PACKED, "done long, runs string", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, at: str, by: str, value: str, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by tumbling event-time window, or by sliding ones that start every ``slide``; rows later than the watermark allows are left out of finished windows."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(window, by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def session_windows(events: DataFrame, at: str, by: str, value: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by session: rows of one ``by`` less than ``gap`` apart."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what there is and return what it wrote."""
    spark, out = stream.sparkSession, f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "complete":
        # Each batch has the whole result. Executors write it in place of the last one: none of its rows pass the driver.
        writer.foreachBatch(lambda whole, _: whole.write.mode("overwrite").parquet(out)).start().awaitTermination()
        spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(out)  # without input there was no batch
    else:
        writer.format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
