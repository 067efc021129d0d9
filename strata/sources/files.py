"""Small files and folders of a store, through Hadoop's file systems."""

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path("")))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> None:
        """Writes a new file as a whole; fails if it exists, and then leaves it as it is."""
        part = self._path(f".{name}.part")
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(part, self._path(name), none)
        except Exception as e:
            self.fs.delete(part, False)
            raise FileExistsError(name) from e

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
