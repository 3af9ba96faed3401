import re

import __spark_entry__ as entry
from quillspark.plans import catalog


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.QUERIES) > 70


def test_core_names_no_training_data_package():
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"quillspark[./]llm", path.read_text()), path
