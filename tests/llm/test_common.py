from millrace.llm import common


def test_folders_name_their_file_system(spark):
    """A path without a scheme is qualified by Spark's default file system, and tasks write there."""
    folder = common.new_folder(spark, "x")
    assert folder.startswith("file:/")
    uri, out = common.new_file(folder, "part", ".bin")
    out.write(b"abc")
    out.close()
    fs, path = common.file_system(uri)
    assert fs.open_input_file(path).read() == b"abc"
    assert spark.read.format("binaryFile").load(uri).first()["content"] == b"abc"


def test_unused_names(spark):
    frame = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert common.unused(frame, "a") == "a__" and common.unused(frame, "b") == "b"
