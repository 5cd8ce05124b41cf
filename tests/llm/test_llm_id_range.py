import pytest

from shelfline.llm import separator_scan


@pytest.mark.parametrize("bad", [-1, 65536, 70000, 115840])
def test_ids_that_do_not_fit_are_refused(llm, tmp_path, bad):
    """70000 would become 4464, and 115840 the separator itself."""
    encoded = llm.createDataFrame([([0, 1, 65535],), ([7, bad],)], "ids array<int>")
    with pytest.raises(Exception, match="an id beyond 0 to 65535"):
        separator_scan.write_flat_files(encoded, str(tmp_path / "flat"), 50304)
