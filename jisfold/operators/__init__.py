"""Part of jisfold."""
