import pytest

pytest.importorskip("tidestat.llm")
