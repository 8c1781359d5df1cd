"""Scalar expressions: buckets, predicates, keys, address arithmetic, encodings."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxprint.schemas import DEVICE_TYPES, EXTERNAL_TYPE, SERVICE_PORTS, SERVICES, UNSET


# B1
def touches_mac(mac: str | None, orig: str = "orig_l2_addr", resp: str = "resp_l2_addr",
                initiated_only: bool = True) -> Column:
    """Rows of one device by hardware address; without an address, all rows."""
    if mac is None:
        return F.lit(True)
    hit = F.col(orig) == mac
    if not initiated_only:
        hit = hit | (F.col(resp) == mac)
    return F.coalesce(hit, F.lit(False))


# B3
def bucket_start(ts: Column, window: int) -> Column:
    return (F.floor(ts / F.lit(window)) * window).cast("bigint")


def utc_hour(epoch: Column) -> Column:
    """Hour of day from an epoch; pure arithmetic, so no session zone is involved."""
    return F.floor(F.pmod(epoch, F.lit(86400)) / 3600).cast("int")


# B4
def is_endpoint_domain(name: Column) -> Column:
    return ~F.lower(name).rlike(r"\.(local|arpa)$")


# B5
def looks_like_hostname(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[^ ]*\.\p{L}{2,}$"), F.lit(False))


# B6
def certificate_names(subject: Column) -> Column:
    """Host-shaped common names of a certificate subject, as an array."""
    parts = F.transform(F.split(subject, ","), lambda p: F.trim(p))
    named = F.filter(parts, lambda p: p.startswith("CN="))
    bare = F.transform(named, lambda p: F.regexp_replace(F.lower(F.trim(F.substr(p, F.lit(4)))), r"^[*.]+", ""))
    return F.filter(bare, lambda n: looks_like_hostname(n))


# B7
def mac_from_name(name: Column) -> Column:
    token = F.regexp_extract(name, r"(?:^|_)([0-9A-Fa-f]{12})(?:\.[^_]*)?$", 1)
    return F.when(token != "", F.lower(F.regexp_replace(token, r"(..)(?!$)", "$1:")))


# B8
def service_category(proto: Column, port: Column) -> Column:
    """The port names the service; only an unlisted port looks at the transport."""
    out = None
    for service, ports in SERVICE_PORTS.items():
        out = (F.when if out is None else out.when)(port.isin(ports), service)
    return out.otherwise(F.when(proto == "udp", "other_udp").otherwise("other_tcp"))


# B9
def port_key(proto: Column, port: Column) -> Column:
    return F.when(proto.isNotNull() & port.isNotNull(), F.concat_ws("/", proto, port.cast("string")))


def external_node(proto: Column, port: Column) -> Column:
    return F.concat(F.lit("external_service:"), service_category(proto, port))


# B10
def digest(*fields: str) -> Column:
    """Identity of a document: hash of its fields in name order, NULLs kept."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


# B11
def signed_log_ratio(a: Column, b: Column) -> Column:
    return F.log1p(a) - F.log1p(b)


def clip(value: Column, low: float, high: float) -> Column:
    """NULL stays NULL (greatest/least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


# B12
def day_angle(epoch: Column, offset: Column | None = None) -> Column:
    seconds = epoch if offset is None else epoch + F.coalesce(offset, F.lit(0))
    return F.pmod(seconds.cast("double"), F.lit(86400.0)) * F.lit(2.0) * F.pi() / F.lit(86400.0)


# B13
def one_hot(value: Column, names: Sequence[str], prefix: str) -> list[Column]:
    return [F.coalesce((value == n).cast("int"), F.lit(0)).alias(prefix + n) for n in names]


def type_one_hot(value: Column) -> list[Column]:
    return one_hot(value, [*DEVICE_TYPES, EXTERNAL_TYPE], "type_")


def service_set_one_hot(services: Column) -> list[Column]:
    return [F.coalesce(F.array_contains(services, s).cast("int"), F.lit(0)).alias("service_" + s) for s in SERVICES]


# B14
def epoch_unit_factor(median: Column) -> Column:
    """Seconds per unit of an epoch column, judged by its median."""
    return (F.when(median > 1e15, F.lit(1e-9)).when(median > 1e12, F.lit(1e-6))
            .when(median > 1e10, F.lit(1e-3)).otherwise(F.lit(1.0)))


# B15
def device_from_file(name: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    undated = F.regexp_replace(stem, r"[-_]\d{4}-\d{2}-\d{2}$", "")
    return F.regexp_replace(undated, r"(?i)[-_](day|part)?\d+$", "")


# B16
def ipv4_number(address: Column) -> Column:
    """Dotted IPv4 text as a number; anything else is NULL, never an error."""
    parts = F.split(address, r"\.")
    octets = [F.element_at(parts, i).cast("bigint") for i in (1, 2, 3, 4)]
    number = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    shaped = address.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    return F.when(shaped, number)


def network_parts(network: Column) -> tuple[Column, Column]:
    """Base number and prefix length of an IPv4 network; NULL if malformed."""
    base = ipv4_number(F.element_at(F.split(network, "/"), 1))
    suffix = F.when(F.size(F.split(network, "/")) == 2, F.element_at(F.split(network, "/"), -1)).otherwise("32")
    bits = F.when(suffix.rlike(r"^\d{1,2}$") & (F.expr("1=1")), suffix.cast("int"))
    bits = F.when((bits >= 0) & (bits <= 32), bits)
    return F.when(bits.isNotNull(), truncate_ipv4(base, bits)), F.when(base.isNotNull(), bits)


def truncate_ipv4(number: Column, bits: Column) -> Column:
    """First address of the enclosing network of the given prefix length."""
    span = F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
    return number - F.pmod(number, span)


# IPv4 ranges that do not route on the public internet, with the
# two addresses inside them that do.
PRIVATE_RANGES = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
                  "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
                  "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32"]
PUBLIC_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]


# The same for IPv6, and the ranges inside them that are public.
PRIVATE_RANGES_6 = ["::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10"]
PUBLIC_EXCEPTIONS_6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


def _private_number(number: Column) -> Column:
    def within(ranges: list[str]) -> Column:
        out = F.lit(False)
        for text in ranges:
            net = ipaddress.ip_network(text)
            out = out | number.between(int(net[0]), int(net[-1]))
        return out

    return F.coalesce(within(PRIVATE_RANGES) & ~within(PUBLIC_EXCEPTIONS), F.lit(False))


def is_private_ipv4(address: Column) -> Column:
    return _private_number(ipv4_number(address))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is long to compute and used often: it becomes the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv6_digits(address: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address in any of its spellings; NULL for anything else."""
    text = F.lower(address)
    tail = F.regexp_extract(text, r"(?<=:)(\d+\.\d+\.\d+\.\d+)$", 1)
    number = ipv4_number(tail)
    plain = F.when(tail == "", text).when(number.isNotNull(), F.concat(
        F.regexp_replace(text, r"[\d.]+$", ""), F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(0xFFFF)))))
    listed = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"

    def digits(halves: Column) -> Column:
        first, second = F.get(halves, F.lit(0)), F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        left, right = (F.filter(F.split(h, ":"), lambda g: g != "") for h in (first, second))
        many = F.size(left) + F.size(right)
        shaped = first.rlike(listed) & second.rlike(listed) & (((F.size(halves) == 1) & (many == 8)) | ((F.size(halves) == 2) & (many <= 7)))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - many, F.lit(0)))
        return F.when(shaped, F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ""))

    return _once(F.when(address.contains(":"), F.split(plain, "::")), digits)


def canonical_ip(address: Column) -> Column:
    """One text per address: IPv4 as it is, IPv6 lower-case with its longest run of zero groups as ``::``; NULL if malformed."""
    def shortest(text: Column) -> Column:
        out = text
        for n in range(2, 9):
            run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
            out = F.when(text.rlike(run), F.regexp_replace(text, run, "$1::$2")).otherwise(out)
        return out

    groups = lambda digits: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
    six = _once(_once(ipv6_digits(address), lambda d: F.when(d.isNotNull(), F.array_join(groups(d), ":"))), shortest)
    return F.when(ipv4_number(address).isNotNull(), address).otherwise(six)


def valid_ip(address: Column) -> Column:
    return F.coalesce(ipv4_number(address).isNotNull() | ipv6_digits(address).isNotNull(), F.lit(False))


def truncate_ipv6(digits: Column, bits: Column) -> Column:
    """The first ``bits`` of an address, as hexadecimal digits."""
    rest = F.pmod(bits, F.lit(4))
    digit = F.conv(F.substr(digits, F.floor(bits / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    last = F.when(rest > 0, F.lower(F.hex(digit - F.pmod(digit, F.pow(F.lit(2), 4 - rest).cast("int")))))
    return F.concat(F.substr(digits, F.lit(1), F.floor(bits / 4).cast("int")), F.coalesce(last, F.lit("")))


def network_parts_6(network: Column) -> tuple[Column, Column]:
    """Digits of the first address and prefix length of an IPv6 network; NULL if malformed."""
    parts = F.split(network, "/")
    suffix = F.when(F.size(parts) == 1, "128").when(F.size(parts) == 2, F.get(parts, F.lit(1)))
    bits = F.when(suffix.rlike(r"^\d{1,3}$"), suffix.cast("int"))
    digits = ipv6_digits(F.get(parts, F.lit(0)))
    fine = digits.isNotNull() & bits.between(0, 128)
    return F.when(fine, truncate_ipv6(digits, bits)), F.when(fine, bits)


def ipv6_in_network(address: Column, network: Column) -> Column:
    base, bits = network_parts_6(network)
    return F.coalesce(truncate_ipv6(ipv6_digits(address), bits) == base, F.lit(False))


def is_private_ipv6(address: Column) -> Column:
    """A mapped IPv4 address counts as that."""
    def within(digits: Column, ranges: list[str]) -> Column:
        out = F.lit(False)
        for text in ranges:
            net = ipaddress.IPv6Network(text)
            out = out | digits.between(f"{int(net[0]):032x}", f"{int(net[-1]):032x}")
        return out

    def private(digits: Column) -> Column:
        four = _once(F.conv(F.substr(digits, F.lit(25)), 16, 10).cast("bigint"), _private_number)
        return F.when(digits.startswith("0" * 20 + "ffff"), four).otherwise(within(digits, PRIVATE_RANGES_6) & ~within(digits, PUBLIC_EXCEPTIONS_6))

    return F.coalesce(_once(ipv6_digits(address), private), F.lit(False))


# B17
# Display names that splitting at capitals would get wrong.
DISPLAY_NAMES = {
    "AmazonEcho": "Amazon Echo",
    "AugustDoorBell": "August Doorbell",
    "BelkinWemoMotionSensor": "Belkin WeMo Motion Sensor",
    "BelkinWemoSwitch": "Belkin WeMo Switch",
    "HPPrinter": "HP Printer",
    "LiFXBulb": "LIFX Bulb",
    "NestDropCam": "Nest Dropcam",
    "NetatmoWeatherStation": "Netatmo Weather Station",
    "NetatmoWelcome": "Netatmo Welcome",
    "PhilipsHue": "Philips Hue",
    "SamsungCamera": "Samsung Camera",
    "SamsungSmartThings": "Samsung SmartThings",
}


def display_name(device_id: Column) -> Column:
    raw = F.element_at(F.split(F.coalesce(F.when(device_id != "", device_id), F.lit("Unknown device")), "_"), 1)
    known = F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, raw), F.regexp_replace(raw, r"(?<=[^\p{Lu}])(\p{Lu})", " $1"))


def null_if_unset(raw: Column) -> Column:
    return F.when(~raw.isin(UNSET), raw)
