"""Hand-written inputs (see FIXTURES.md)."""

from connlearn.schema import RecordSchema

CONN_SCHEMA = RecordSchema.from_names(
    ["duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "urgent", "label"])

TRAIN_LINES = [
    "0,tcp,http,SF,181,5450,0,0,normal.",
    "0,tcp,http,SF,239,486,0,0,normal.",
    "2,udp,dns,SF,44,133,0,0,normal.",
    "0,tcp,http,S0,0,0,0,0,synflood.",
    "0,tcp,http,S0,0,0,1,0,synflood.",
    "0,tcp,http,S0,10,0,0,0,synflood.",
    "5,icmp,eco,SF,8,0,0,0,scan.",
    "7,icmp,eco,SF,18,0,0,0,scan.",
]

TEST_LINES = [
    "0,tcp,http,SF,200,900,0,0,normal.",
    "0,tcp,http,S0,0,0,0,0,synflood.",
    "1,tcp,ftp,SF,50,60,0,0,normal.",
    "1,tcp,http,SF,50,60,0,9,normal.",
    "3,udp,dns,SF,1,1,0,0,wormx.",
    "3,icmp,eco,SF,8,0,0,0,portscan.",
]

MALFORMED_LINES = ["x,tcp,http,SF,1,1,0,0,normal.", "0,tcp,http", ""]


def lines_df(spark, lines, with_id=True):
    rows = [(i, v) for i, v in enumerate(lines)]
    df = spark.createDataFrame(rows, "id bigint, value string")
    return df if with_id else df.select("value")
