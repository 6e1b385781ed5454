"""Labelled training lines for the credential labeller, made up by a seeded generator.

The lines follow the common ways in which code, configuration, shells and
comments hold credentials and things that look like them; names, values and
words are drawn from general lists and from random syllables.
"""

from __future__ import annotations

import base64
import random

_NOUNS = (
    "account agent album alert anchor apple archive arrow asset badge banner barrel basket beacon bicycle billing blanket bottle branch bridge bucket budget button cabin cable camera candle canvas carbon castle cellar chapter charge cherry circle client cloud cluster coffee column copper corner cotton country cradle customer daemon dealer desert device dinner dragon engine export fabric falcon feather filter finger flower forest fossil garden gateway ginger glacier gravel guitar hammer harbor hazel helmet hockey import index insect island jacket jungle kernel kettle ladder lantern lemon letter library lizard locker magnet mailer maple marble market meadow memory metric mirror mobile monkey museum napkin needle notice number object ocean office orange orchid outlet oyster packet palace parcel parser pebble pencil pepper picnic pillow pilot pirate planet pocket policy portal potato printer puzzle quarry rabbit rainbow record region remote report ribbon river rocket saddle sample schema screen search season sensor server session shadow signal silver socket spider spring square stable station storage stream studio summer sunset switch tablet target temple tenant ticket timber tomato tower trader tunnel turtle umpire update vendor vessel victor violet walnut warden water wheel widget window winter wizard worker yellow zephyr zipper"
).split()
_LINKS = "the a an is was in of for with and to on by from at this that must be has have not until before after when if it as your please enter are can will should".split()
_SECRET = ["password", "passwd", "pwd", "pw", "pass", "passphrase", "passcode", "passwort", "kennwort", "clave", "contrasena", "senha", "secret", "token", "tok", "apikey", "api_key", "access_token", "auth_token", "client_secret", "secret_key", "signing_key", "encryption_key", "private_key", "access_key", "bearer", "credential", "cred", "license_key", "webhook_secret", "auth_key", "mdp", "login_key", "key", "auth"]
_STRONG_AT = 13
_OTHER = ["hash", "digest", "checksum", "label", "name", "id", "column", "field", "limit", "count", "length", "hint", "prompt", "title", "path", "file", "type", "kind", "header", "url", "ttl", "policy", "prefix", "version", "state", "index"]
_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
_MARKS = "!?*+%=~^&@.#$-_"


class LineMaker:
    """Makes (line, spans of credentials) pairs; equal seeds make equal lines."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def some(self, chars: str, low: int, high: int | None = None) -> str:
        return "".join(self.r.choice(chars) for _ in range(self.r.randint(low, high or low)))

    def word(self) -> str:
        if self.r.random() < 0.75:
            return self.r.choice(_NOUNS)
        return "".join(self.r.choice("bcdfghklmnprstvz") + self.r.choice("aeiou") for _ in range(self.r.randint(2, 3)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(_LINKS) if self.r.random() < 0.35 else self.word() for _ in range(self.r.randint(low, high)))

    def styled(self, parts: list[str]) -> str:
        parts = [p for part in parts for p in part.split("_")]
        style = self.r.randrange(5)
        if style == 0:
            return "_".join(parts).upper()
        if style == 1:
            return parts[0] + "".join(p.title() for p in parts[1:])
        if style == 2 and self.r.random() < 0.5:
            return "-".join(parts)
        if style == 3 and self.r.random() < 0.4:
            return "".join(p.title() for p in parts)
        return "_".join(parts)

    def secret_name(self, strong: bool = False) -> str:
        base = self.r.choice(_SECRET[:_STRONG_AT] if strong else _SECRET)
        return self.styled([*([self.word()] if self.r.random() < 0.55 else []), base])

    def other_name(self) -> str:
        return self.styled([*([self.word()] if self.r.random() < 0.3 else []), self.r.choice(_SECRET), self.r.choice(_OTHER)])

    def plain_name(self) -> str:
        return self.r.choice([self.word(), self.styled([self.word(), self.word()]), self.r.choice(["x", "v", "t", "cfg", "conn", "data", "tmp", "opt", "item", "t0", "s", "value"])])

    def weak(self) -> str:
        """A password someone thought of."""
        r = self.r
        return r.choice([
            lambda: f"{self.word().title()}{r.randint(10, 9999)}{self.some(_MARKS, 1, 2)}",
            lambda: "-".join(self.word() for _ in range(r.randint(2, 4))) + str(r.randint(1, 99)),
            lambda: f"{self.word()}{r.choice(_MARKS)}{self.word().title()}{r.randint(0, 99)}",
            lambda: f"{self.word().title()}{r.choice('!.@+*')}{self.word().title()}",
            lambda: self.some(_LOWER + _UPPER + _DIGITS, 8, 18), lambda: self.some(_LOWER + _UPPER + _DIGITS, 8, 18),
            lambda: self.some(_LOWER + _UPPER + _DIGITS + _MARKS, 8, 18),
        ])()

    def strong(self) -> str:
        """A key or token that a service issued."""
        r, alnum = self.r, _LOWER + _UPPER + _DIGITS
        return r.choice([
            lambda: r.choice(["AKIA", "ASIA"]) + self.some(_UPPER + _DIGITS, 16), lambda: r.choice(["ghp_", "gho_", "ghs_"]) + self.some(alnum, 36), lambda: f"xoxb-{self.some(_DIGITS, 11)}-{self.some(_DIGITS, 11)}-{self.some(alnum, 24)}",
            lambda: f"eyJ{self.some(alnum, 18, 30)}.eyJ{self.some(alnum, 30, 60)}.{self.some(alnum + '-_', 43)}", lambda: self.some(alnum + "-_", 24, 46), lambda: self.some(alnum + "+/", 38, 43) + r.choice(["", "=", "=="]),
            lambda: self.some(_HEX, r.choice([32, 40, 48, 64])), lambda: f"{self.some(_HEX, 8)}:{self.some(alnum, 22)}", lambda: f"{self.some(_LOWER, 2, 4)}_{r.choice(['live', 'prod', 'test', self.some(_LOWER, 3)])}_{self.some(alnum, 20, 34)}",
            lambda: "glpat-" + self.some(alnum + "-_", 20), lambda: "AIza" + self.some(alnum + "-_", 35), lambda: self.some(alnum, 20, 40),
        ])()

    def host(self) -> str:
        r = self.r
        return r.choice([f"{self.word()}.{self.word()}.{r.choice(['example', 'test', 'internal', 'invalid', 'local', 'com'])}", f"{self.word()}-{r.randint(1, 40)}.{self.word()}.{r.choice(['example', 'test'])}", "localhost", f"10.{r.randint(0, 255)}.0.{r.randint(1, 254)}:{r.randint(1000, 9999)}"])

    def hollow(self) -> str:
        """What stands where a credential would: placeholders, masks, references."""
        r = self.r
        w = self.word().upper()
        return r.choice(["", "none", "null", f"<{r.choice(['your', 'the', 'my'])}-{r.choice(['token', 'key', 'password', 'secret'])}>", f"YOUR_{r.choice(['API_KEY', 'TOKEN', 'SECRET', 'PASSWORD'])}", "REPLACE_ME", "changeme", "change-me", f"insert-{r.choice(['key', 'token'])}-here", "<redacted>", "[REDACTED]", "*" * r.randint(4, 12), "x" * r.randint(4, 16), "X" * r.randint(4, 12), f"${{{w}}}", f"${w}", f"{{{{ {self.word()}_{r.choice(['key', 'password'])} }}}}", f"%({self.word()})s", "%s", "TODO", "dummy", "example", "...", f"your_{r.choice(['secret', 'token', 'password'])}_here", f"enter-{r.choice(['password', 'token'])}", "<password>", "PASSWORD", "{password}", "fake-token", "test", "xxx"])

    def assigned(self, name: str, value: str, note: str = "") -> str:
        q = self.r.choice("\"\"\"''`") if "'" not in value and "`" not in value else "\""
        if q == "'" and len(value) == 1:
            q = "\""
        form = self.r.choice(["{n} = {q}{v}{q}", "{n} := {q}{v}{q}", "const {n} = {q}{v}{q};", "let {n}: string = {q}{v}{q};", "let {n}: &str = {q}{v}{q};", "String {n} = {q}{v}{q};", "const char *{n} = {q}{v}{q};", "${n} = {q}{v}{q};", "var {n} = {q}{v}{q};", "{n}={q}{v}{q}", "\"{n}\": {q}{v}{q},", "{n}: {q}{v}{q},", "self.{n} = {q}{v}{q}", "private static final String {n} = {q}{v}{q};", "'{n}' => {q}{v}{q},", ":{n} => {q}{v}{q},", "static {n}: &str = {q}{v}{q};", "cfg[{q}{n}{q}] = {q}{v}{q}", "export const {n} = {q}{v}{q};", "define('{n}', {q}{v}{q});", "#define {n} \"{v}\"", "this.{n} = {q}{v}{q};", "if {n} == {q}{v}{q} {{", "connect({n}={q}{v}{q})", "new Client({{ {n}: {q}{v}{q} }})"])
        return form.format(n=name, q=q, v=value) + (f" {self.r.choice(['//', '#'])} {note}" if note else "")

    def comment(self, text: str) -> str:
        return self.r.choice(["// ", "# ", "* ", "-- ", "/* ", "- ", "//", "    # ", "    // ", " * "]) + text

    # each maker returns (line, credentials in it, in order)

    def in_code(self) -> tuple[str, list[str]]:
        v = self.weak() if self.r.random() < 0.5 else self.strong()
        strong_name = len(v) < 20
        return self.assigned(self.secret_name(strong_name), v, self.words(1, 5) if self.r.random() < 0.25 else ""), [v]

    def letters_only(self) -> tuple[str, list[str]]:
        v = self.some(_LOWER + _UPPER, 8, 14)
        return self.assigned(self.secret_name(True), v), [v]

    def phrase(self) -> tuple[str, list[str]]:
        v = " ".join(self.word() for _ in range(self.r.randint(3, 5))) + self.r.choice(["", "", f" {self.r.randint(1, 99)}", "!"])
        return self.assigned(self.secret_name(True), v), [v]

    def noted(self) -> tuple[str, list[str]]:
        v = self.strong()
        note = self.r.choice([f"{self.word()} {self.r.choice(['key', 'token', 'secret', 'password'])}", f"{self.r.choice(['key', 'token', 'secret', 'credential'])} {self.r.choice(['for', 'of'])} {self.words(1, 3)}", f"{self.words(0, 2)} {self.r.choice(['api key', 'prod key', 'signs requests', 'do not commit', 'production secret'])}"]).strip()
        return self.assigned(self.plain_name(), v, note), [v]

    def joined(self) -> tuple[str, list[str]]:
        v = self.strong()
        cut = self.r.randint(6, len(v) - 6)
        name = self.secret_name() if self.r.random() < 0.8 else "s"
        join = self.r.choice(["+", ".", "", "&", ".."])
        return f"{self.r.choice(['const ', '', 'let ', 'String '])}{name} = \"{v[:cut]}\" {join} \"{v[cut:]}\"{self.r.choice(['', ';'])}", [v[:cut], v[cut:]]

    def address(self) -> tuple[str, list[str]]:
        v = self.some(_LOWER + _UPPER + _DIGITS + "-_.!", 7, 18) if self.r.random() < 0.7 else self.strong().replace("/", "x").replace(":", "x")
        url = f"{self.r.choice(['postgres', 'postgresql', 'redis', 'mongodb', 'mongodb+srv', 'https', 'amqp', 'mysql', 'ftp', 'smtp'])}://{self.r.choice(['', 'app', 'root', 'svc_' + self.word(), self.word(), 'admin'])}:{v}@{self.host()}{self.r.choice(['', '/' + self.word(), '/0', '/' + self.word() + '?ssl=true'])}"
        name = self.r.choice(["url", "dsn", "conn", "broker", "endpoint", "DATABASE_URL", "uri", self.plain_name()])
        return self.r.choice([self.assigned(name, url), f"{name}={url}", f"{name}: {url}", self.comment(f"{self.words(0, 3)} {url}"), f"git clone {url}", f"    {url}"]), [v]

    def query(self) -> tuple[str, list[str]]:
        v = self.strong().replace(":", "x").replace("=", "")
        return self.assigned(self.plain_name(), f"https://{self.host()}/{self.word()}?{self.r.choice(['token', 'api_key', 'access_token', 'key', 'sig', 'secret'])}={v}"), [v]

    def connection(self) -> tuple[str, list[str]]:
        v = self.weak().replace(";", "").replace("=", "").replace("\"", "")
        text = f"{self.r.choice(['Server', 'Host', 'Data Source'])}={self.host()};{self.r.choice(['Uid', 'User Id', 'user'])}={self.word()};{self.r.choice(['Pwd', 'Password', 'password'])}={v};"
        return f"{self.r.choice(['conn = ', '', 'string c = '])}\"{text}{self.r.choice(['', 'Database=' + self.word() + ';'])}\"{self.r.choice(['', ';'])}", [v]

    def login_header(self) -> tuple[str, list[str]]:
        kind = self.r.choice(["Basic", "Bearer", "Bearer", "token", "Token"])
        v = base64.b64encode(f"{self.word()}:{self.weak()}".encode()).decode() if kind == "Basic" else self.strong()
        head = f"{self.r.choice(['Authorization', 'authorization', 'Proxy-Authorization'])}: {kind} {v}"
        if self.r.random() < 0.2:
            head = f"{self.r.choice(['X-Api-Key', 'X-Auth-Token', 'PRIVATE-TOKEN'])}: {v}"
        q = self.r.choice("'\"")
        return self.r.choice([self.assigned(self.plain_name(), head), self.comment(head), head, f"curl -H {q}{head}{q} https://{self.host()}/{self.word()}", f"headers = {{\"Authorization\": \"{kind} {v}\"}}", f"req.Header.Set(\"Authorization\", \"{kind} {v}\")", self.comment(f"curl -H {q}{head}{q} https://{self.host()}/"), f"  -H {q}{head}{q} \\"]), [v]

    def config(self) -> tuple[str, list[str]]:
        strong = self.r.random() < 0.5
        v = (self.strong() if strong else self.weak()).replace(" ", "")
        name = self.secret_name(not strong)
        return self.r.choice(["{n}: {v}", "  {n}: {v}", "{N}={v}", "export {N}={v}", "{n} = {v}", "ENV {N} {v}", "set {N}={v}", "- {N}={v}", "{n}={v}", "    {n}: {v}", "{N}: {v}", "spring.{n}={v}"]).format(n=name, N=name.upper().replace("-", "_"), v=v), [v]

    def flag(self) -> tuple[str, list[str]]:
        v = (self.strong() if self.r.random() < 0.6 else self.weak()).replace("'", "").replace("`", "")
        flag = self.r.choice(["--token", "--password", "--key", "--api-key", "--secret", "-p", "--auth-token", "--pass"])
        return f"{self.r.choice(['', '$ ', '# ', '// '])}{self.word()} {self.r.choice(['login', 'deploy', 'push', 'auth', self.word()])} {self.r.choice(['', '--user ' + self.word() + ' '])}{flag}{self.r.choice([' ', '='])}{v}", [v]

    def user_pair(self) -> tuple[str, list[str]]:
        v = self.weak().replace("'", "").replace("\"", "").replace("@", "x")
        return f"{self.r.choice(['', '$ ', '# '])}curl -u {self.word()}:{v} https://{self.host()}/{self.word()}", [v]

    def machine(self) -> tuple[str, list[str]]:
        v = self.weak()
        return f"machine {self.host()} login {self.word()} password {v}", [v]

    def element(self) -> tuple[str, list[str]]:
        v = self.weak().replace("'", "").replace("\"", "").replace("&", "x").replace("`", "")
        n = self.secret_name(True)
        return self.r.choice([f"<add key='{n}' value='{v}'/>", f"<property name=\"{n}\" value=\"{v}\"/>", f"<add key=\"{n}\" value=\"{v}\" />", f"<{n}>{v}</{n}>", f"<entry key=\"{n}\">{v}</entry>", f"{{\"name\": \"{n}\", \"value\": \"{v}\"}}", f"- name: {n.upper().replace('-', '_')} value: {v}"]), [v]

    def call(self) -> tuple[str, list[str]]:
        v = self.weak().replace("\"", "").replace("'", "").replace("`", "")
        verb = self.r.choice(["connect", "login", "dial", "authenticate", "signIn", "open", "auth", "db.connect", "client.login", "sql.connect"])
        q = self.r.choice("\"\"'")
        parts = [f"{q}{self.host()}{q}"] if self.r.random() < 0.7 else []
        parts += [str(self.r.randint(21, 9999))] if self.r.random() < 0.5 and parts else []
        parts += [f"{q}{self.r.choice([self.word(), 'root', 'admin', 'svc_' + self.word()])}{q}", f"{q}{v}{q}"]
        return f"{self.r.choice(['', 'x = ', 'const c = ', 'await '])}{verb}({', '.join(parts)}){self.r.choice(['', ';'])}", [v]

    def record(self) -> tuple[str, list[str]]:
        v = (self.weak() if self.r.random() < 0.6 else self.strong()).replace("\"", "")
        return f"{self.plain_name()} = {{\"{self.r.choice(['user', 'host', 'login', 'name'])}\": \"{self.word()}\", \"{self.secret_name(True)}\": \"{v}\"}}", [v]

    def private_key(self) -> tuple[str, list[str]]:
        head = f"-----BEGIN {self.r.choice(['RSA ', 'EC ', 'OPENSSH ', '', 'DSA ', 'ENCRYPTED '])}PRIVATE KEY-----"
        body = self.r.choice(["", "", "\\n" + self.some(_LOWER + _UPPER + _DIGITS + "+/", 64) + "\\n" + self.some(_LOWER + _UPPER + _DIGITS, 40)])
        return f"{self.r.choice(['', '', 'const pem = ', 'key := ', self.plain_name() + ' = ', 'private_key: '])}{self.r.choice(['', '`', chr(34), chr(39) * 3])}{head}{body}", [head]

    def told(self) -> tuple[str, list[str]]:
        v = self.weak() if self.r.random() < 0.5 else self.strong()
        noun = self.r.choice(["password", "pw", "pwd", "token", "secret", "passphrase", "api key", "key", "login token", "root password"])
        link = self.r.choice([" is ", " was ", ": ", " = ", " ", " -> ", "=", " (", " changed to ", " now "])
        before, after = self.words(0, 3), self.r.choice(["", "", "", " " + self.words(1, 4), ", " + self.words(1, 3), ")" if link == " (" else "."])
        return self.comment(f"{before} {noun}{link}{v}{after}".strip()), [v]

    def account(self) -> tuple[str, list[str]]:
        v = self.weak() if self.r.random() < 0.7 else self.strong()
        noun = self.r.choice(["login", "user", "account", "creds", "credentials", "access"])
        return self.comment(f"{self.words(0, 2)} {noun}{self.r.choice([': ', ' ', ' = '])}{self.r.choice([self.word(), 'admin', 'root'])}{self.r.choice([' / ', ', password ', ' with password ', ' pw ', ' / pass '])}{v}".strip()), [v]

    # without credentials

    def no_value(self) -> tuple[str, list[str]]:
        name, v = self.secret_name(), self.hollow()
        w = self.word().upper()
        return self.r.choice([self.assigned(name, v), self.assigned(name, v), f"{name}: {v}", f"{w}_{self.r.choice(['TOKEN', 'PASSWORD', 'KEY'])}={v}", f"curl -u {self.word()}:{v or '****'} https://{self.host()}/", f"Authorization: Bearer {v or '<token>'}", self.comment(f"{self.words(0, 2)} {name} is {v}"), f"{self.word()} login --token {v or '$TOKEN'}", self.assigned("url", f"{self.r.choice(['postgres', 'redis', 'https'])}://{self.word()}:{v or '****'}@{self.host()}/db"), self.assigned(self.plain_name(), f"Authorization: {self.r.choice(['Basic', 'Bearer'])} {v or '<token>'}"), f"connect(\"{self.host()}\", \"{self.word()}\", \"{v}\")", f"<add key='{name}' value='{v}'/>"]), []

    def reference(self) -> tuple[str, list[str]]:
        n, w, u = self.secret_name(), self.word(), self.word().upper()
        k = self.r.choice(["TOKEN", "KEY", "PASSWORD", "SECRET", "PASS"])
        return self.r.choice([f"{n} = os.environ[\"{u}_{k}\"]", f"{n} = os.getenv('{u}_{k}')", f"const {n} = process.env.{u}_{k};", f"String {n} = System.getenv(\"{u}_{k}\");", f"{n} := os.Getenv(\"{u}_{k}\")", f"{n} = load_secret(\"{w}/{self.word()}\")", f"let {n}: String = env::var(\"{u}_{k}\").unwrap();", f"{n} = vault.read(\"{w}/{self.word()}\")[\"{self.secret_name()}\"]", f"{n} = get_secret(\"{w}-{self.word()}-{self.r.randint(1, 9)}\")", f"{n} = config[\"{n}\"]", f"{n}=${u}_{k}", f"{n}: ${{{u}_{k}}}", f"$x = getenv('{u}_{k}');", f"{n} = ENV['{u}_{k}']", f"{n} = ENV.fetch(\"{u}_{k}\")", f"{n} = self.{n}", f"login(user={w}, {n}={n})", f"{n}={n},", f"client.auth({n})", f"{n} = args.{n}", f"string {n} = Environment.GetEnvironmentVariable(\"{u}_{k}\");", f"this.{n} = {n};", f"{n} = input(\"{self.words(1, 2)} {self.r.choice(['password', 'token'])}: \")", f"{n} = getpass.getpass()", f"{n} = keyring.get_password(\"{w}\", \"{self.word()}\")", f"{n} = {w}.{self.word()}({n})", f"{n}: {{{{ .Values.{w}.{self.word()} }}}}", f"from: secretKeyRef {w}-{self.word()}", f"  key: {w}-{self.word()}", f"{n} = Config.get(\"{w}.{self.word()}\")"]), []

    def digest(self) -> tuple[str, list[str]]:
        hexes, b64 = self.some(_HEX, self.r.choice([12, 32, 40, 64])), self.some(_LOWER + _UPPER + _DIGITS + "+/", 86)
        name = self.r.choice(["checksum", "digest", "integrity", "etag", "commit", "revision", "build_sha", "hash", "md5", "sha256", "fingerprint", "tree", "parent", "rev", self.word() + "_hash", self.word() + "Sha"])
        return self.r.choice([self.assigned(name, hexes), self.assigned(name, hexes), f"{name}: {hexes}", f"{name} = {hexes}", self.assigned(name, f"sha256:{self.some(_HEX, 64)}"), self.assigned(name, f"sha512-{b64}=="), self.assigned(name, f"md5:{self.some(_HEX, 32)}"), f"git {self.r.choice(['checkout', 'revert', 'show', 'cherry-pick'])} {hexes}", f"commit {self.some(_HEX, 40)}", f"{self.some(_HEX, 64)}  {self.word()}.tar.gz", self.comment(f"{self.r.choice(['fixed in', 'see', 'reverts', 'since', 'see change', 'as of commit', 'introduced in'])} {hexes}{self.r.choice(['', ' ' + self.words(1, 4)])}"), f"sha256sum: {self.some(_HEX, 64)}", f"uses: {self.word()}/{self.word()}@{self.some(_HEX, 40)}", f"\"{self.word()}@{self.r.randint(0, 9)}.{self.r.randint(0, 20)}\": \"{self.some(_HEX, 40)}\","]), []

    def password_hash(self) -> tuple[str, list[str]]:
        alnum = _LOWER + _UPPER + _DIGITS
        v = self.r.choice([f"pbkdf2:{self.r.randint(1, 9)}0000:{self.some(_HEX, 16)}:{self.some(_HEX, 64)}", f"pbkdf2_sha256$260000${self.some(alnum, 12)}${self.some(alnum + '+/', 43)}=", f"$2b$12${self.some(alnum + './', 53)}", f"$2a$10${self.some(alnum, 53)}", f"$argon2id$v=19$m=65536${self.some(alnum, 40)}", f"scrypt:{self.some(_HEX, 64)}", f"$6$rounds=5000${self.some(alnum, 86)}", self.some(_HEX, 64)])
        return self.assigned(self.styled([self.r.choice(["password", "pw", "passwd", "secret", "token"]), self.r.choice(["hash", "digest"])]) if self.r.random() < 0.75 else self.styled(["hashed", "password"]), v), []

    def identity(self) -> tuple[str, list[str]]:
        i = self.some(_HEX, 32)
        uuid = f"{i[:8]}-{i[8:12]}-{i[12:16]}-{i[16:20]}-{i[20:]}"
        return self.r.choice([self.assigned(self.styled([self.r.choice(["request", "token", "session", "key", "trace", self.word()]), self.r.choice(["id", "uuid"])]), self.r.choice([uuid, i, self.some(_LOWER + _DIGITS, 10, 20)])), f"{self.word()}_id: {uuid}", self.comment(f"{self.words(1, 3)} {uuid}")]), []

    def blob(self) -> tuple[str, list[str]]:
        alnum = _LOWER + _UPPER + _DIGITS
        return self.r.choice([self.assigned("fingerprint", ":".join(self.some(_HEX, 2) for _ in range(16))), self.assigned(self.r.choice(["icon", "logo", "image", self.word()]), f"data:image/png;base64,{self.some(alnum + '+/', 80)}"), self.some(alnum + "+/", 44, 64), f"-----END {self.r.choice(['RSA ', ''])}PRIVATE KEY-----", f"-----BEGIN {self.r.choice(['PUBLIC KEY', 'CERTIFICATE', 'RSA PUBLIC KEY'])}-----", self.assigned(self.r.choice(["public_key", "pub", "pubKey", "cert"]), f"-----BEGIN {self.r.choice(['', 'RSA '])}PUBLIC KEY-----\\n{self.some(alnum, 40)}\\n-----END PUBLIC KEY-----"), self.assigned(self.r.choice(["public_key", "ssh_pub_key", "pubkey"]), f"ssh-{self.r.choice(['rsa', 'ed25519'])} {self.some(alnum + '+/', 60)} {self.word()}@{self.word()}"), f"ssh-rsa {self.some(alnum + '+/', 80)}"]), []

    def about(self) -> tuple[str, list[str]]:
        n, k = self.other_name(), self.r.choice(["password", "token", "key", "secret", "pw", "login"])
        return self.r.choice([self.assigned(n, self.r.choice([self.word(), self.word() + "_" + k, k, f"{self.word()}/{self.word()}", self.words(2, 5), str(self.r.randint(1, 999)), self.word().title(), "/" + self.word() + "/" + self.word()])), f"{n} = {self.r.randint(1, 9999)}", f"\"{self.secret_name(True)}\": \"{self.r.choice(['Enter', 'Please enter', 'Forgot', 'Your', 'Type', 'Wrong', 'The', 'Invalid', 'Confirm'])} {self.words(1, 5)}{self.r.choice(['?', '', '.', ':'])}\",", self.assigned(self.r.choice(["error", "message", "label", "title", "hint", "text", self.word()]), f"{self.words(1, 2)} {k} {self.words(1, 4)}"), f"raise ValueError(\"{self.words(0, 2)} {k} {self.words(1, 3)}\")", f"throw new Error('{k} {self.words(2, 4)}');", f"assert {self.secret_name()} != \"\"", f"if {k} == \"{self.word()}\":", f"{self.secret_name()} = {self.r.choice(['None', 'null', 'nil', '0', 'true', 'false', '[]'])}", f"type {self.word().title()}{k.title()} string", f"{self.secret_name()}: {self.r.choice(['string', 'str', 'String', 'number', 'Optional[str]', 'bool'])}{self.r.choice(['', ';', ',', ' = None'])}", f"\"{self.secret_name()}\": {{\"type\": \"string\"}},", self.assigned(self.styled(["token", "type"]), self.r.choice(["bearer", "Bearer", "basic"]))]), []

    def speech(self) -> tuple[str, list[str]]:
        k = self.r.choice(["password", "token", "key", "secret", "pw", "passphrase", "credentials", "login"])
        return self.comment(self.r.choice([f"{self.words(0, 3)} {k} {self.words(1, 6)}", f"{k} = {self.words(3, 6)}", f"{k}: {self.words(3, 6)}", f"the {k} {self.words(2, 6)}", f"{self.words(2, 8)}", f"see https://{self.host()}/{self.word()}#{self.word()}", f"{k} {self.r.choice(['has', 'is', 'must be'])} {self.r.randint(2, 64)} {self.r.choice(['characters', 'bytes', 'long'])}", f"{self.words(1, 4)} {self.r.randint(1, 2030)} {self.words(1, 3)}", f"{self.words(1, 3)} {self.styled([self.word(), self.word(), k])} {self.words(1, 3)}", f"{self.word()}_{self.word()}_{k} {self.words(1, 3)}"]).strip()), []

    def ordinary(self) -> tuple[str, list[str]]:
        a, b, n = self.word(), self.word(), self.r.randint(0, 999)
        k = self.r.choice(["key", "token", "auth", "pass", "secret"])
        name = self.styled([a, b, k]) if self.r.random() < 0.5 else self.styled([k, a, str(n)])
        name = name.replace("-", "_")
        hexes = hex(self.r.randint(0, 65535))
        return self.r.choice([f"def {name}({k}, {a}):", f"fn {name}({k}: &str, n: i64) -> i64 {{", f"function {name}({k}) {{", f"return {name}({a}, {n});", f"total += {name}({a}, {hexes})", f"import {{ {name} }} from \"./{a}-{n}.js\";", f"from {a}.{b} import {name}", f"for {k} in {a}_{k}s:", f"{a}.set(\"{k}\", \"{b}{n}\")", f"{name.upper()} = {n}", f"#define {name.upper()} {hexes}", f"const {name.upper()}: i64 = {n};", f"public static final int {name.upper()} = {hexes};", f"static long {name}(const long *{k}) {{", self.assigned(a, f"{b}-{n}"), self.assigned(a, f"/srv/{b}/{a}{n}.txt"), self.assigned(a, f"v{self.r.randint(1, 9)}.{self.r.randint(0, 20)}.{self.r.randint(0, 9)}"), self.assigned(a, self.host()), self.assigned(a, f"#{self.some(_HEX, 6)}"), self.assigned(a, self.words(2, 5)), self.assigned("url", f"https://{self.host()}/v1/{b}"), f"{name} = {b}[{n}] + {a}.{k}_{b}", f"case \"{k}\": return {n};", f"{name}: {n},", f"map[\"{name}\"] = {a}{n}", f"assertEqual({name}({n}), \"{b}-{n}\")", f"logger.info(\"{self.words(1, 4)} {k}\")", f"cache_{k} = f\"{a}:{{{b}}}:{n}\"", f"{a}_{b}_{n} = {a}.{b}({n})", f"\"{a}\": \"{self.some(_LOWER, 3)}-{n}-{b}\",", f"sort(key=lambda x: x.{a})", f"{k} = \"{a}_{b}\"", f"{k} = \"{a}\"", f"primary_{k} = \"{a}_{b}_{n}\"", f"foreign_{k}: {a}.{b}_id", f"{a}.{k}s().map({k} => {k}.{b})", f"}} else if ({k} === '{a}') {{"]), []


    def setting(self) -> tuple[str, list[str]]:
        v = self.r.choice([self.host(), self.host(), self.host(), str(self.r.randint(1, 99999)), f"/{self.word()}/{self.word()}", self.word(), f"{self.word()}-{self.r.randint(1, 99)}", "true", "off", f"{self.r.randint(1, 90)}s", f"{self.word()}.{self.word()}", f"{self.r.randint(1, 9)}.{self.r.randint(0, 30)}.{self.r.randint(0, 9)}", f"{self.word()},{self.word()}", f"https://{self.host()}/{self.word()}"])
        n = self.styled([self.word(), self.r.choice(["host", "port", "path", "mode", "size", "name", "user", "region", "level", "timeout", self.word()])])
        return self.r.choice([f"{n.upper().replace('-', '_')}={v}", f"{n}: {v}", f"  {n}: {v}", f"export {n.upper().replace('-', '_')}={v}", f"{n} = {v}", f"- {n}={v}", f"\"{n}\": \"{v}\","]), []

    def definition(self) -> tuple[str, list[str]]:
        verb = self.r.choice(["get", "set", "read", "write", "has", "is", "make", "load", "parse", "visit", "check", "on", self.word()])
        name = self.styled([verb, self.word(), *([self.word()] if self.r.random() < 0.6 else []), *([self.r.choice([self.r.choice(_LOWER), ""]) + str(self.r.randint(0, 999)).zfill(self.r.randint(1, 3))] if self.r.random() < 0.6 else [])]).replace("-", "_")
        a = self.word()
        return self.r.choice([f"def {name}({a}):", f"def {name}({a})", f"func {name}({a} []int64) int64 {{", f"func (s *{a.title()}) {name}() error {{", f"function {name}(${a}) {{", f"export function {name}({a}: number[]): number {{", f"pub fn {name}({a}: &[i64]) -> i64 {{", f"static long {name}(const long *{a}) {{", f"public static long {name}(long[] {a}) {{", f"class {name.title()}:", f"return {name}({a})", f"{name}({a}, {self.r.randint(0, 99)});", f"    {name}:", f"{a} = {name}({a}) + {self.r.randint(0, 999)}", f"sub {name} {{", f"async {name}({a}) {{", f"const {name} = ({a}) => {a} + {self.r.randint(1, 9)};", f"int {name}(int {a}[{self.r.randint(1, 64)}]);"]), []

    def rows(self) -> tuple[str, list[str]]:
        a, b, n, m = self.word(), self.word(), self.r.randint(0, 9999), self.r.randint(0, 99)
        return self.r.choice([f"{{\"id\": {m}, \"{a[:self.r.randint(1, 6)]}\": {n}, \"{self.word()}\": \"{b}\"}},", f"{{\"{a}\": \"{b}\", \"n\": {n}}}", f"[{m}, {n}, \"{b}\"],", f"({n}, '{a}', '{b}-{m}'),", f"{n},{a},{b},{m}.5", f"{n}, 0x{n:x}, {m}, 0x{m:x},", f"{a}|{b}|{n}", f"\"{a}\": [{m}, {n}],", f"{a}_{b} = \"{a}-{m}\"", f"{self.host()}", f"{m}.{a}.example", f"{a}.{b}.{self.r.choice(['example', 'test', 'invalid'])}:{n}"]), []

    def foreign(self) -> tuple[str, list[str]]:
        letters = self.r.choice(["äöüß", "éèêàç", "áíóñú", "ãõçâ", "åøæ", "łęśż", "ひらがな", "日本語文"])
        def word() -> str:
            w = self.some(_LOWER, 2, 11)
            at = self.r.randint(0, len(w))
            return w[:at] + (self.r.choice(letters) if self.r.random() < 0.4 else "") + w[at:]
        parts = [word() for _ in range(self.r.randint(4, 14))]
        if self.r.random() < 0.6:
            parts.insert(self.r.randint(0, len(parts)), str(self.r.randint(1, 2000)))
        text = " ".join(parts).capitalize() + self.r.choice([".", ",", "", ". " + word().title()])
        return self.r.choice([text, text, self.comment(text), f"\"\"\"{text}\"\"\""]), []

    def prose(self) -> tuple[str, list[str]]:
        text = self.words(4, 16)
        if self.r.random() < 0.6:
            parts = text.split()
            parts.insert(self.r.randint(0, len(parts)), self.r.choice([str(self.r.randint(0, 9999)), f"{self.r.randint(1, 99)}%", f"{self.word()}-{self.word()}", f"v{self.r.randint(1, 9)}.{self.r.randint(0, 9)}", f"{self.word().title()}{self.r.randint(0, 9)}", f"`{self.word()}_{self.word()}`", f"{self.word()}'s", f"{self.word()}/{self.word()}", f"#{self.r.randint(1, 9999)}", self.word().upper(), f"({self.word()})"]))
            text = " ".join(parts)
        stop = self.r.choice(["", ".", ". " + self.words(1, 4).capitalize(), ",", ":"])
        text = (text.capitalize() if self.r.random() < 0.5 else text) + stop
        return self.r.choice([text, text, self.comment(text), f"\"\"\"{text}\"\"\"", f"r\"\"\"{text}", f"- {text}", f"{self.r.randint(1, 9)}. {text}", f"## {text}", f"\"\"\"{self.r.choice(['TODO', 'FIXME', 'XXX', 'NOTE'])}: {text}", self.comment(f"{self.r.choice(['TODO', 'FIXME', 'NOTE'])}: {text}"), f"print(\"{text}\")", f"log.warn('{text}', {self.word()});"]), []


POSITIVE = "in_code in_code in_code in_code letters_only phrase noted noted noted joined address address query connection login_header login_header config config config flag user_pair machine element call call record private_key told told told account".split()
NEGATIVE = "no_value no_value no_value reference reference reference digest digest digest password_hash identity blob about about about speech speech speech ordinary ordinary ordinary ordinary setting setting setting setting setting definition definition definition definition prose prose prose prose prose prose rows rows rows foreign foreign blob".split()


def credential_lines(n: int, seed: int = 3) -> list[tuple[str, list[tuple[int, int]]]]:
    """(line, spans of credentials) of ``n`` made-up lines."""
    maker = LineMaker(seed)
    out: list[tuple[str, list[tuple[int, int]]]] = []
    while len(out) < n:
        line, secrets = getattr(maker, maker.r.choice(POSITIVE if maker.r.random() < 0.4 else NEGATIVE))()
        line = maker.r.choice(["", "", "", "    ", "        ", "\t"]) + line
        spans, at = [], 0
        for s in secrets:
            at = line.index(s, at)
            spans.append((at, at + len(s)))
            at += len(s)
        out.append((line, spans))
    return out
