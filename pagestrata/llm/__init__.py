"""Training-data operators and their queries; nothing outside this folder imports it."""
