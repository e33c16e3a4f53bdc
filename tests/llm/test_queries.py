"""The queries of the problems over a small folder."""

import pytest

from tests.comparing import compare, connect
from tidemark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": ["hit_id", "priority"], "p2_found": ["run_id", "turn_idx", "word_idx"], "p3_found": ["run_id", "first_idx", "last_idx", "speaker_no"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(map(str, rows))) == len(rows)
    if name in ORACLES:
        compare(df, connect(FOLDER), ORACLES[name])
