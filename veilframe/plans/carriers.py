"""Texts made from table columns, with the span they must give.

The given documents hold few of the formats that the detectors know.  A carrier
writes a column value in such a format into a sentence, one sentence per row of
a table: ``before || value || after``.  Where the span has to be follows from
the construction, so a query on a carrier can be checked with plain SQL.  All
expressions are SQL that both Spark and the checking engine read alike.
"""

from __future__ import annotations

from dataclasses import dataclass

YEAR = "cast(year(o_orderdate) as string)"
MONTH = "cast(month(o_orderdate) as string)"
DAY = "cast(day(o_orderdate) as string)"
MONTH2 = f"lpad({MONTH}, 2, '0')"
DAY2 = f"lpad({DAY}, 2, '0')"
PRICE = "cast(cast(o_totalprice as decimal(15,2)) as string)"
TENS = "cast(cast(floor(o_totalprice / 10000) as int) as string)"
ORDER_HASH = "md5(cast(o_orderkey as string))"
CUST_CODE = f"concat('CUST-', {YEAR}, '-', lpad(cast(o_custkey as string), 9, '0'))"
CONTRACT_CODE = f"concat('HT-', {YEAR}, '-', lpad(cast(o_orderkey as string), 9, '0'))"
MAIL = "concat('c', cast(o_custkey as string), '@shop.example.com')"
PHONE_NUMBER = "concat('13', lpad(cast(o_custkey as string), 9, '0'))"


def padded(key: str) -> str:
    """A key as a source id whose text order is the number order."""
    return f"lpad(cast({key} as string), 12, '0')"


@dataclass(frozen=True)
class Carrier:
    table: str
    key: str
    before: str
    value: str
    after: str
    entity: str
    action: str
    detector: str
    hit: str = "true"

    @property
    def text(self) -> str:
        return f"concat({self.before}, {self.value}, {self.after})"

    def expected_sql(self) -> str:
        """The findings, from the construction alone."""
        return f"""
            SELECT {padded(self.key)} AS source_id,
                   CAST(length({self.before}) AS BIGINT) AS start_pos,
                   CAST(length({self.before}) + length({self.value}) AS BIGINT) AS end_pos,
                   {self.entity} AS entity_type, {self.action} AS action, {self.detector} AS detector,
                   {self.value} AS value
            FROM {self.table} WHERE {self.hit}"""


def _by(column: str, choices: dict[str, str], other: str) -> str:
    tests = " ".join(f"when '{name}' then {value}" for name, value in choices.items())
    return f"case {column} {tests} else {other} end"


CARRIERS = {
    "phone": Carrier(
        "customer", "c_custkey",
        "concat('联系电话', case when c_mktsegment = 'BUILDING' then '0' else '' end)",
        "concat('1', cast(3 + c_nationkey % 7 as string), lpad(cast(c_custkey as string), 9, '0'))",
        "'。'", "'PHONE'", "'redact'", "'cn-phone'", "c_mktsegment <> 'BUILDING'",
    ),
    "id_card": Carrier(
        "orders", "o_orderkey", "'身份证'",
        f"concat('110105', {YEAR}, {MONTH2}, {DAY2}, lpad(cast(o_orderkey % 1000 as string), 3, '0'), "
        "case when o_orderstatus = 'P' then 'X' else cast(o_custkey % 10 as string) end)",
        "'。'", "'ID_CARD'", "'redact'", "'cn-id-card'",
    ),
    "bank_card_groups": Carrier(
        "customer", "c_custkey", "'卡号：'",
        "concat('6222 ', lpad(cast(c_nationkey as string), 4, '0'), ' ', substr(lpad(cast(c_custkey as string), 8, '0'), 1, 4), "
        "' ', substr(lpad(cast(c_custkey as string), 8, '0'), 5, 4))",
        "case when c_mktsegment = 'MACHINERY' then ' 9999，' else '，' end",
        "'BANK_CARD'", "'redact'", "'bank-card'",
    ),
    "uscc": Carrier(
        "supplier", "s_suppkey", "'信用代码'",
        "concat('91', lpad(cast(s_nationkey as string), 6, '0'), 'MA', lpad(cast(s_suppkey as string), 8, '0'))",
        "'。'", "'USCC'", "'tokenize'", "'cn-uscc'",
    ),
    "contract": Carrier(
        "orders", "o_orderkey", "'签署'",
        f"concat({_by('o_orderstatus', {'F': chr(39) + 'HT-' + chr(39), 'O': chr(39) + 'nda' + chr(39)}, chr(39) + 'So-' + chr(39))}, "
        f"{YEAR}, '-', lpad(cast(o_orderkey as string), 9, '0'))",
        "'，生效'", "'CONTRACT_ID'", "'tokenize'", "'contract-id'",
    ),
    "customer_id": Carrier(
        "orders", "o_orderkey", "'编号为'", CUST_CODE, "'。'", "'CUSTOMER'", "'tokenize'", "'customer-id'"
    ),
    "sample": Carrier(
        "orders", "o_orderkey", "'样本'",
        f"concat('Sample-', {YEAR}, {MONTH2}, {DAY2}, '-', o_orderstatus, lpad(cast(o_orderkey as string), 9, '0'))",
        "'。'", "'SAMPLE_ID'", "'tokenize'", "'sample-id'",
    ),
    "project": Carrier(
        "part", "p_partkey", "'项目代号：'",
        "concat('GZO-', replace(p_brand, '#', ''), '-', replace(p_name, ' ', '-'), '-', lpad(cast(p_size as string), 3, '0'))",
        "'。'", "'PROJECT'", "'tokenize'", "'project-code'",
    ),
    "money": Carrier(
        "orders", "o_orderkey", "'金额'",
        _by("o_orderstatus", {"F": f"concat('人民币', {PRICE}, '元')", "O": f"concat('¥', {TENS}, '万')"}, f"concat('$ ', {PRICE})"),
        "'，'", "'MONEY'", "'bucket'", "'money'",
    ),
    "date": Carrier(
        "orders", "o_orderkey", "'日期 '",
        _by(
            "o_orderstatus",
            {
                "F": f"concat({YEAR}, '-', {MONTH2}, '-', {DAY2})",
                "O": f"concat({YEAR}, '/', {MONTH}, '/', {DAY})",
            },
            f"concat({YEAR}, '年', {MONTH}, '月', {DAY}, '日')",
        ),
        "'，'", "'DATE'", "'month_only'", "'cn-date'",
    ),
    "email_after_chinese": Carrier(
        "customer", "c_custkey",
        "case when c_mktsegment = 'FURNITURE' then '邮箱' else '邮箱 ' end",
        "concat('c', cast(c_custkey as string), '@shop', cast(c_nationkey as string), '.example.com')",
        "'，'", "'EMAIL'", "'mask'", "'email'", "c_mktsegment <> 'FURNITURE'",
    ),
    "person_context": Carrier(
        "customer", "c_custkey", "'联系人：'",
        "concat(substr('赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔', 1 + c_nationkey, 1), substr('明华建国志强文军', 1 + cast(c_custkey % 8 as int), 1))",
        "'，'", "'PERSON'", "'tokenize'", "'cn-person-context'",
    ),
    "person_common": Carrier(
        "customer", "c_custkey", "'今天'",
        "substr('张三李四王五赵六陈七刘强王芳李娜张伟', 1 + 2 * (c_nationkey % 9), 2)",
        "'到访。'", "'PERSON'", "'tokenize'", "'cn-person-common'",
    ),
    "org_context": Carrier(
        "supplier", "s_suppkey", "'供应商：'", "concat(replace(s_name, '#', ''), '有限公司')",
        "'，'", "'ORG'", "'tokenize'", "'cn-org-context'",
    ),
    "org_generic": Carrier(
        "supplier", "s_suppkey", "'x7给'", "concat('Lab', cast(s_suppkey as string), '集团')",
        "' y'", "'ORG'", "'tokenize'", "'cn-org-generic'",
    ),
    "address": Carrier(
        "customer", "c_custkey", "'，'",
        "concat(substr('江浙皖闽赣鲁豫鄂湘粤', 1 + c_nationkey % 10, 1), '东省南山区')",
        "'中，'", "'ADDRESS'", "'generalize'", "'cn-address'",
    ),
    "secrets": Carrier(
        "orders", "o_orderkey", "concat('id ', o_orderstatus, ' ')",
        _by(
            "o_orderpriority",
            {
                "1-URGENT": f"concat('sk-proj-', {ORDER_HASH})",
                "2-HIGH": f"concat('AKIA', upper(substr({ORDER_HASH}, 1, 16)))",
                "3-MEDIUM": f"concat('ghp_', substr({ORDER_HASH}, 1, 28))",
                "4-NOT SPECIFIED": f"concat('PassWord: ', {ORDER_HASH})",
            },
            f"concat('Set-Cookie: sid=', {ORDER_HASH})",
        ),
        "concat(chr(10), 'end')",
        _by("o_orderpriority", {"4-NOT SPECIFIED": "'PASSWORD'", "5-LOW": "'COOKIE'"}, "'API_KEY'"),
        "'fail'",
        _by(
            "o_orderpriority",
            {"1-URGENT": "'openai-key'", "2-HIGH": "'aws-key'", "3-MEDIUM": "'github-token'", "4-NOT SPECIFIED": "'password'"},
            "'cookie'",
        ),
    ),
    "key_blocks": Carrier(
        "orders", "o_orderkey", "'x '",
        _by(
            "o_orderstatus",
            {
                "F": f"concat('eyJ', {ORDER_HASH}, '.', {ORDER_HASH}, '.', {ORDER_HASH})",
                "O": f"concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), {ORDER_HASH}, chr(10), '-----END RSA PRIVATE KEY-----')",
            },
            "'none'",
        ),
        "' y'",
        _by("o_orderstatus", {"F": "'JWT'"}, "'PRIVATE_KEY'"),
        "'fail'",
        _by("o_orderstatus", {"F": "'jwt'"}, "'private-key'"),
        "o_orderstatus <> 'P'",
    ),
}

# A sentence per order with six kinds of values, and its parts.
NOTE_PARTS = (
    "'客户编号'", CUST_CODE, "'，合同'", CONTRACT_CODE, "'，金额'", f"concat('人民币', {PRICE}, '元')",
    "'，日期 '", f"concat({YEAR}, '-', {MONTH2}, '-', {DAY2})", "'，邮箱 '", MAIL, "'，电话'", PHONE_NUMBER, "'。'",
)
NOTE = f"concat({', '.join(NOTE_PARTS)})"
