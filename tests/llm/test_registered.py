"""All operators of this package and the pipeline are registered where the package is present."""

import __spark_entry__ as entry


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in entry.queries() if name.startswith("op"))
    assert numbers == list(range(1, 14))
    assert "pipeline" in entry.queries()
