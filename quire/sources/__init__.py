"""Where tables come from: recorded answers of services, Markdown tables, local texts."""
