"""Readers of source trees and tables."""
