"""URIs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def repaired_uri(uri: Column | str) -> Column:
    """Without enclosing <>, blanks as %20."""
    u = _c(uri)
    bare = F.when(F.startswith(u, F.lit("<")) & F.endswith(u, F.lit(">")) & (F.length(u) > 1), F.substring(u, F.lit(2), F.length(u) - 2)).otherwise(u)
    return F.replace(bare, F.lit(" "), F.lit("%20"))


def percent_quoted(text: Column | str) -> Column:
    """Percent-encoded as UTF-8; letters, digits and _.-~/ stay."""
    out = F.url_encode(_c(text))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def encoded_value(value: Column | str) -> Column:
    """A header value as ASCII: as it is, or percent-quoted if it has no parameters; null where parameters must be rewritten one by one."""
    v = _c(value)
    plain = ~v.rlike(r"[^\x00-\x7f]")
    return F.when(plain, v).when(~F.contains(v, F.lit(";")), percent_quoted(v))


def base_name(path: Column | str) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(_c(path), "/", -1), -1)


def request_url(target: Column | str, host: Column | str, port: Column | str, default_port: Column | str, verb: Column | str | None = None, tunnel: Column | str | None = None) -> Column:
    """struct(url, proxy_host) of a request sent to a host: the absolute URL, and the proxy if there is one.

    The scheme is https where the connection's default port is 443; that port is left out. CONNECT
    opens a tunnel and has no URL itself; ``tunnel`` is its target, host or host:port, for the requests
    that follow on the same connection (null without one): they go to that host, by way of this one.
    """
    t, h, p, d = _c(target), _c(host), _c(port).cast("int"), _c(default_port).cast("int")
    through = _c(tunnel) if tunnel is not None else F.lit(None).cast("string")
    opens = F.coalesce(F.upper(_c(verb)) == "CONNECT", F.lit(False)) if verb is not None else F.lit(False)
    far_host = F.coalesce(F.substring_index(through, ":", 1), h)
    far_port = F.when(through.isNull(), p).otherwise(F.coalesce(F.regexp_extract(through, r":(\d+)$", 1).try_cast("int"), d))
    scheme = F.when(d == 443, "https").otherwise("http")
    absolute = F.startswith(t, F.lit("http:")) | F.startswith(t, F.lit("https:"))
    place = F.concat(scheme, F.lit("://"), far_host, F.when(far_port == d, "").otherwise(F.concat(F.lit(":"), far_port.cast("string"))))
    url = F.when(absolute, t).when(~opens, F.concat(place, t))
    by_tunnel = F.when(opens | through.isNotNull(), F.concat(F.lit("https://"), h, F.lit(":"), p.cast("string")))
    by_proxy = F.when(absolute & ~opens, F.concat(F.lit("http://"), far_host, F.lit(":"), far_port.cast("string")))
    return F.struct(F.when(~opens, url).alias("url"), F.coalesce(by_proxy, by_tunnel).alias("proxy_host"))
