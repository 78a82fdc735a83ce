"""Small rows that several tests use."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = [
    (1, "Yield rose from 4.25 to 6.75 t with 1,000 plots [1] and [2, 3].", "Nó tăng từ 4,25 lên 6 t với 1.000 ô [1]."),
    (2, "We water at dawn (Okoro et al., 2018); see `log.csv` and $x+1$.", "Chúng ta tưới lúc rạng đông (Okoro, 2018), xem log.csv và $x+1$."),
    (3, "Use 3e-4 and 0.7 at https://example.org/a now.", "Dùng 3e-4 và 0,7 một cách rõ ràng; được đo bởi https://example.org/b nay."),
    (4, "", ""),
    (5, "Plain words only", "the beds are from the house and of the sea"),
    (6, "In Okoro (2019) and Dvorak and Sato, 2021b", "Theo Okoro (2019) và Dvorak"),
]
LAYERS = [
    ("soil moisture", "độ ẩm đất|ẩm độ đất", "general", 0), ("sensor", "cảm biến|bộ cảm", "general", 0), ("harvest", "mùa gặt", "general", 0),
    ("Soil Moisture", "lượng ẩm trong đất", "general", 1), ("mulch", "lớp phủ gốc", "general", 1), ("NDVI", "NDVI", "general", 0), ("token", "token", "ml", 0),
]
#: A log of readings under several heads.
LOG = """Rain Gauge Log of the Upper Meadow

Setup
The gauge stands on a post. We read it at 7 each day, 31 times [3], and
the readings went to `rain.csv`.

1 Dry weeks
Little fell, 12.5 mm in all.

2 Wet weeks
Much fell (Sato, 2015), so that the post leaned, and we set it upright again.
r = a * h + b / k  (2)
Week 21 22 23
Rain 40 52 61

Bibliography
[3] H. Sato. On posts. 2015.
"""


def layers(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(*x, k) for k, x in enumerate(LAYERS)], "en string, joined string, domain string, prec int, row bigint")
    return rows.select("en", F.split("joined", r"\|").alias("vi"), "domain", F.lit("").alias("note"), F.when(F.col("prec") == 0, "builtin").otherwise("paper").alias("source"), "row", "prec")
