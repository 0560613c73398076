"""Entity types and the fixed word tables of detection and restoring."""

# Entity type -> alias prefix. The first nine are identities, aliased by default; the rest are structure, left readable.
IDENTITY = {
    "organization": "ORG", "product": "PRODUCT", "brand": "BRAND", "partner": "PARTNER", "payment_provider": "PAYMENT_PROVIDER",
    "person": "PERSON", "tenant": "TENANT", "environment": "ENV", "domain": "DOMAIN",
}
STRUCTURE = {
    "service": "SERVICE", "api": "API", "endpoint": "ENDPOINT", "table": "DB_TABLE", "column": "COLUMN", "dto": "DTO",
    "interface": "IFACE", "enum": "ENUM", "event": "EVENT", "index": "INDEX", "env_var": "ENV_VAR", "path_segment": "PATH",
}
PREFIX = IDENTITY | STRUCTURE

# Names of public payment providers and of other public vendors.
PAYMENT_PROVIDERS = (
    "Stripe", "Adyen", "Braintree", "PayPal", "Klarna", "Mollie", "GoCardless", "Razorpay", "Worldpay", "Checkout.com", "Payoneer",
    "Skrill", "Nuvei", "BlueSnap", "Recurly", "Chargebee", "Zuora", "Marqeta", "Afterpay", "Authorize.Net",
)
PARTNERS = (
    "Auth0", "Okta", "Keycloak", "OneLogin", "WorkOS", "Twilio", "SendGrid", "Mailgun", "Postmark", "Mailchimp", "Vonage",
    "MessageBird", "Datadog", "Sentry", "PagerDuty", "Grafana", "Splunk", "LaunchDarkly", "Databricks", "Mixpanel", "Algolia",
    "Contentful", "Cloudinary", "Salesforce", "HubSpot", "Zendesk", "NetSuite", "Shopify", "Xero",
)

# Words after which a person's name follows.
PERSON_MARKERS = (
    "author", "authors", "contact", "owner", "owners", "maintainer", "maintainers", "assignee", "reviewer", "reviewed-by",
    "reviewed by", "written-by", "written by", "reported-by", "reported by", "signed-off-by", "co-authored-by",
)

# Names that are never candidates.
STOP_LIST = (
    "TypeScript", "JavaScript", "Rust", "Python", "Java", "Kotlin", "Node", "Deno", "Bun", "React", "Angular", "Vue", "Svelte",
    "Express", "Fastify", "NestJS", "Next", "Remix", "Django", "Rails", "Spring", "Jest", "Vitest", "Mocha", "Cypress", "Playwright",
    "Prisma", "TypeORM", "Sequelize", "Postgres", "PostgreSQL", "MySQL", "SQLite", "MongoDB", "Redis", "Elasticsearch", "Kafka",
    "RabbitMQ", "AWS", "Azure", "GCP", "Kubernetes", "Docker", "Terraform", "Nginx", "Linux", "Windows", "macOS", "OpenAPI", "JSON",
    "YAML", "XML", "HTML", "CSS", "HTTP", "HTTPS", "REST", "GraphQL", "gRPC", "OAuth", "JWT", "UUID", "SQL", "API", "SDK", "CLI", "URL",
    "URI", "PATH", "HOME", "USER", "SHELL", "PORT", "HOST", "DEBUG", "LOG_LEVEL", "NODE_ENV", "RUST_LOG", "TZ", "LANG", "CI", "Promise",
    "Date", "Error", "String", "Number", "Boolean", "Object", "Array", "Map", "Set", "Record",
)

# Endings of compound names and the type each tells.
TYPED_SUFFIXES = (
    ("Service", "service"), ("Controller", "service"), ("Repository", "interface"), ("Repo", "interface"), ("Api", "api"),
    ("API", "api"), ("Client", "api"), ("Dto", "dto"), ("DTO", "dto"), ("Request", "dto"), ("Response", "dto"), ("Payload", "dto"),
    ("Entity", "dto"), ("Model", "dto"), ("Tier", "enum"), ("Status", "enum"), ("Kind", "enum"), ("Type", "enum"),
    ("Created", "event"), ("Updated", "event"), ("Deleted", "event"), ("Issued", "event"), ("Cancelled", "event"), ("Event", "event"),
)

# Words that begin sentences rather than names.
SENTENCE_STARTERS = (
    "The", "This", "That", "These", "Those", "There", "Then", "They", "Their", "When", "Where", "What", "Which", "While", "With",
    "Without", "Every", "Each", "Some", "Any", "All", "Both", "Either", "Neither", "For", "From", "Into", "Only", "Also", "But", "And",
    "Not", "Card", "Data", "Run", "External", "Multi", "Clients", "Version", "Status",
)

# What models append to a name.
AFFIXES = ("Impl", "Implementation", "Service", "Class", "Type", "Interface", "Dto", "Model", "Base", "Abstract", "Default", "New", "V2", "Ext")

# Extensions that a module resolver drops.
MODULE_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json")

# Format -> file extensions.
FORMATS = {
    "markdown": ("md", "markdown", "mdown", "mkd"), "sql": ("sql", "ddl"), "yaml": ("yaml", "yml"), "json": ("json",),
    "typescript": ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"), "plantuml": ("puml", "plantuml", "pu", "iuml", "wsd"),
    "text": ("txt", "text", "log", "csv"),
}

#: Ordinary single words that identify nobody. A short default of our own; callers pass their language's list as a table or sequence.
COMMON_WORDS = (
    "account", "address", "amount", "api", "card", "client", "code", "config", "customer", "data", "date", "error", "event", "file",
    "group", "index", "invoice", "item", "key", "list", "name", "node", "number", "order", "page", "part", "payment", "person", "plan",
    "price", "product", "region", "report", "role", "service", "status", "system", "table", "team", "text", "time", "title", "token",
    "type", "user", "value", "version",
)

#: Kinds of one concept that may meet in different artifacts.
UNIFIABLE = ("table", "dto", "interface", "enum", "service", "api", "event")
COMPATIBLE = (("table", "dto"), ("table", "interface"), ("table", "enum"), ("dto", "interface"), ("dto", "enum"), ("service", "api"), ("service", "event"))
