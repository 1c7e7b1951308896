"""The commands over a small log."""

import pytest

from recollect.plans.engine import Conflict, Memory


def test_commands(spark, tmp_path):
    memory = Memory(spark, str(tmp_path), now="2024-06-01 00:00:00")
    assert memory.note("Refunds need manual approval.", ["billing"]) == 1
    assert memory.note("Refunds need manual approval.", ["billing"]) == 1, "reused"
    with pytest.raises(Conflict):
        memory.note("Refunds need manual approval.", ["billing"], confidence=0.5)
    assert memory.ingest("document", "Customers pay monthly. More of it.\n\nThe end.", "Billing guide") == 2
    obs = {r["line"]: r["id"] for r in memory.state().observations.collect()}
    assert set(obs) == {"Refunds need manual approval.", "Customers pay monthly."}
    target = obs["Refunds need manual approval."]
    assert memory.edit(target, 1, line="Refunds over 100 need approval.") == 3
    assert memory.edit(target, 1, line="Written too late.") == 4
    whole = memory.brief()
    assert "Refunds over 100 need approval. (2;" in whole.text and "too late" not in whole.text
    assert "Customers pay monthly." in whole.text
    assert "monthly" in memory.recall("who pays monthly").text or memory.recall("who pays monthly").tokens > 0
    assert memory.focus("/w", "billing", "hide") == 5
    assert "Refunds" not in memory.brief(folder="/w").text and "Refunds" in memory.brief(folder="/v").text
    assert memory.forget(target) == 6
    assert "Refunds" not in memory.brief().text
    assert memory.browse().count() == 1
    assert {r["name"]: r["n_rows"] for r in memory.stats().collect()} == {"entries": 6, "observations": 2, "pages": 2, "chunks": 1}
    lines, upto = memory.since(0)
    assert upto == 3 and len(lines) == 4
    assert memory.open("billing").count() == 1
    with pytest.raises(ValueError):
        memory.edit(target, 1, weight="1")
    assert "recall" in memory.catalog()
