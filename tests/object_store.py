"""A small object store on this machine that speaks as much of S3's protocol as a client of it needs: listing by prefix and
delimiter in pages, reads of ranges, single and multipart writes."""

import threading
from datetime import datetime, timezone
from hashlib import md5
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit
from xml.sax.saxutils import escape

PAGE = 3


def plain_body(raw: bytes, headers) -> bytes:
    """A body without the chunk marks that signing clients put into it."""
    if "aws-chunked" not in headers.get("Content-Encoding", ""):
        return raw
    out, at = b"", 0
    while True:
        end = raw.index(b"\r\n", at)
        size = int(raw[at:end].split(b";")[0], 16)
        if not size:
            return out
        out += raw[end + 2 : end + 2 + size]
        at = end + 4 + size


class ObjectStore:
    """endpoint, and `objects`: {bucket/key: (bytes, time)}; `asked` holds method and path of each request."""

    def __init__(self):
        self.objects, self.parts, self.asked = {}, {}, []
        store = self

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def log_message(self, *_):
                pass

            def answer(self, code=200, body=b"", **headers):
                self.send_response(code)
                for k, v in headers.items():
                    self.send_header(k.replace("_", "-"), v)
                if "Content_Length" not in headers:
                    self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                if self.command != "HEAD":
                    self.wfile.write(body)

            def handle_one(self):
                url = urlsplit(self.path)
                key, query = unquote(url.path).lstrip("/"), {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
                size = int(self.headers.get("Content-Length") or 0)
                raw = self.rfile.read(size) if size else b""
                if "chunked" in self.headers.get("Transfer-Encoding", ""):
                    while n := int(self.rfile.readline().split(b";")[0], 16):
                        raw += self.rfile.read(n)
                        self.rfile.readline()
                    self.rfile.readline()
                store.asked.append((self.command, key, query))
                getattr(self, f"on_{self.command.lower()}")(key, query, plain_body(raw, self.headers))

            do_GET = do_HEAD = do_PUT = do_POST = do_DELETE = handle_one

            def on_get(self, key, query, _):
                if query.get("list-type"):
                    return self.listed(key.strip("/"), query)
                self.on_head(key, query, _)

            def on_head(self, key, query, _):
                if "/" not in key.strip("/"):
                    return self.answer()
                if key not in store.objects:
                    return self.answer(404, b"<Error><Code>NoSuchKey</Code></Error>")
                body, at = store.objects[key]
                size, code, more = len(body), 200, {}
                if wanted := self.headers.get("Range"):
                    low, _, high = wanted.removeprefix("bytes=").partition("-")
                    low, high = int(low), min(int(high or size - 1), size - 1)
                    body, code, more = body[low : high + 1], 206, {"Content_Range": f"bytes {low}-{high}/{size}"}
                self.answer(code, body, ETag=f'"{md5(body).hexdigest()}"', Last_Modified=at.strftime("%a, %d %b %Y %H:%M:%S GMT"), Content_Length=str(len(body)), Accept_Ranges="bytes", **more)

            def listed(self, bucket, query):
                prefix, delimiter = query.get("prefix", ""), query.get("delimiter", "")
                after = query.get("continuation-token", query.get("start-after", ""))
                names: dict[str, bool] = {}
                for k in sorted(x[len(bucket) + 1 :] for x in store.objects if x.startswith(f"{bucket}/")):
                    if k.startswith(prefix):
                        rest = k[len(prefix) :]
                        cut = rest.find(delimiter) if delimiter else -1
                        names[prefix + rest[: cut + 1] if cut >= 0 else k] = cut >= 0
                left = [n for n in names if n > after]
                page = left[: min(PAGE, int(query.get("max-keys", PAGE)))]
                row = lambda n: f"<Contents><Key>{escape(n)}</Key><Size>{len(store.objects[f'{bucket}/{n}'][0])}</Size><LastModified>{store.objects[f'{bucket}/{n}'][1].isoformat(timespec='milliseconds').replace('+00:00', 'Z')}</LastModified></Contents>"
                rows = "".join(f"<CommonPrefixes><Prefix>{escape(n)}</Prefix></CommonPrefixes>" if names[n] else row(n) for n in page)
                more = f"<IsTruncated>true</IsTruncated><NextContinuationToken>{escape(page[-1])}</NextContinuationToken>" if len(left) > len(page) else "<IsTruncated>false</IsTruncated>"
                self.answer(200, f'<?xml version="1.0"?><ListBucketResult><Name>{bucket}</Name><Prefix>{escape(prefix)}</Prefix><KeyCount>{len(page)}</KeyCount>{more}{rows}</ListBucketResult>'.encode(), Content_Type="application/xml")

            def on_put(self, key, query, body):
                if "uploadId" in query:
                    store.parts.setdefault(query["uploadId"], {})[int(query["partNumber"])] = body
                else:
                    store.put(key, body)
                self.answer(200, ETag=f'"{md5(body).hexdigest()}"')

            def on_post(self, key, query, _):
                bucket, _, name = key.partition("/")
                if "uploads" in query:
                    body = f"<InitiateMultipartUploadResult><Bucket>{bucket}</Bucket><Key>{escape(name)}</Key><UploadId>u{len(store.asked)}</UploadId></InitiateMultipartUploadResult>"
                else:
                    parts = store.parts.pop(query["uploadId"], {})
                    store.put(key, b"".join(parts[i] for i in sorted(parts)))
                    body = f'<CompleteMultipartUploadResult><Bucket>{bucket}</Bucket><Key>{escape(name)}</Key><ETag>"x"</ETag></CompleteMultipartUploadResult>'
                self.answer(200, body.encode(), Content_Type="application/xml")

            def on_delete(self, key, query, _):
                store.objects.pop(key, None)
                self.answer(204)

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.endpoint = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def put(self, key: str, body: bytes) -> None:
        self.objects[key] = body, datetime.now(timezone.utc).replace(microsecond=0)

    def close(self) -> None:
        self.server.shutdown()
