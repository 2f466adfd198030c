"""What was asked of a service and what it answered, as it happens: chunks of JSON lines under a folder.

A task notes the rows of a chunk under ``begun`` before it sends them and their answers under ``answers`` after. A file
is moved to its name once it is whole. So a row that is not under begun was not sent, one under answers is known,
and what lies between is in doubt: at most a chunk for each task that died. The folder must be in a file
system that Arrow opens and tasks and driver share.
"""

from __future__ import annotations

import json

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.keyed import first_match

ANSWER = "ordinal long, source_id string, response_id_json string, error string, failed boolean"
SUMMARY = "_summary.json"


class AnswerLog:
    """One writer's part of a log; names of its files begin with ``name``."""

    def __init__(self, folder: str, name: str = ""):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(folder)
        self.name, self.chunk = name, 0
        for kind in ("begun", "answers"):
            self.fs.create_dir(f"{self.root}/{kind}", recursive=True)

    def _put(self, path: str, text: str) -> None:
        place, _, name = path.rpartition("/")
        with self.fs.open_output_stream(f"{place}/_{name}") as out:
            out.write(text.encode())
        self.fs.move(f"{place}/_{name}", path)

    def _lines(self, kind: str, rows: list[dict]) -> None:
        self._put(f"{self.root}/{kind}/{self.name}-{self.chunk:06d}.json", "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))

    def begin(self, ordinals: list[int]) -> None:
        self._lines("begun", [{"ordinal": o} for o in ordinals])

    def end(self, answers: list[dict]) -> None:
        self._lines("answers", answers)
        self.chunk += 1

    def earlier(self) -> list[dict]:
        """The answers that earlier attempts of this writer noted; its own chunks come after theirs."""
        found = []
        for info in self.fs.get_file_info(arrow_fs.FileSelector(f"{self.root}/answers")):
            if info.base_name.startswith(f"{self.name}-"):
                self.chunk = max(self.chunk, int(info.base_name.removesuffix(".json").rpartition("-")[2]) + 1)
                with self.fs.open_input_stream(info.path) as lines:
                    found += [json.loads(x) for x in lines.read().decode().splitlines()]
        return found

    def summarise(self, summary: dict) -> None:
        self._put(f"{self.root}/{SUMMARY}", json.dumps(summary))

    def summary(self) -> dict | None:
        path = f"{self.root}/{SUMMARY}"
        if self.fs.get_file_info(path).type == arrow_fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as text:
            return json.loads(text.read())


def answers_of(spark: SparkSession, folder: str) -> DataFrame:
    """Each row's answer, once: one that did not fail before one that did."""
    rows = spark.read.schema(ANSWER).json(f"{folder}/answers")
    return first_match(rows, ["ordinal"], "failed")


def begun_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("ordinal long").json(f"{folder}/begun").select(F.col("ordinal")).distinct()
