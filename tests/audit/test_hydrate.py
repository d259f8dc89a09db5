"""Path rebuild of folders deeper than six doubling rounds."""

from auditweft.operators import hydrate


def test_deep_folders(spark):
    rows = [(k, "D:", "FS01", "created", f"f{k}", f"f{k - 1}" if k else None, f"n{k}") for k in range(70)]
    journal = spark.createDataFrame(rows, "usn long, volume string, server string, action string, file_id string, parent_file_id string, file_name string")
    got = {r.usn: r.path for r in hydrate.hydrate_usn_paths(journal, "D:\\base").select("usn", "path").collect()}
    assert got == {k: "D:\\base" + "".join(f"\\n{j}" for j in range(k + 1)) for k in range(70)}
